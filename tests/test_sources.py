"""Scans, ignore rules, settings, snapshots, the log and streams, on temporary folders."""

import datetime as dt
import os

import pytest

from pathlens.operators.overlay import apply_events, with_key
from pathlens.operators.search import search
from pathlens.sources import config, fsscan
from pathlens.sources.fsscan import FsMetaReader, scan, scan_report
from pathlens.sources.ignore import IgnoreFilter, parse_rule
from pathlens.sources.snapshots import ConflictError, Snapshots, normal_roots, should_flush, should_snapshot
from pathlens.streaming.live import Pipeline, RebuildGate, discovered, pair_renames_in_state

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def tree(tmp_path):
    for name in ("a/x.txt", "a/skip.log", "a/b/y.md", "node_modules/z.js", ".hidden/h.txt", "top.txt", "a/keep.log"):
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(name)
    (tmp_path / "tree/.gitignore").write_text("*.log\n!keep.log\n")
    os.link(tmp_path / "tree/top.txt", tmp_path / "tree/a/link.txt")
    os.symlink(tmp_path / "tree/top.txt", tmp_path / "tree/a/sym.txt")
    return str(tmp_path / "tree")


def names(df, root):
    return sorted(r.path.removeprefix(root + "/") for r in df.collect())


def test_scan(spark, tree):
    assert names(scan(spark, [tree]), tree) == ["a/b/y.md", "a/keep.log", "a/link.txt", "a/x.txt"]
    everything = names(scan(spark, [tree], hidden=True, ignore=False, exclude_dirs=""), tree)
    assert "node_modules/z.js" in everything and ".hidden/h.txt" in everything and "a/skip.log" in everything
    assert "a/sym.txt" in names(scan(spark, [tree], kind="entries"), tree)
    assert names(scan(spark, [tree], kind="dirs"), tree) == ["a", "a/b"]
    assert names(scan(spark, [tree], max_depth=1), tree) == ["top.txt"]
    assert scan_report(spark, [tree]).first().scanned == 4
    assert scan(spark, [tree + "/none"]).count() == 0
    for paths in ([], [tree] * 11):
        with pytest.raises(ValueError):
            scan_report(spark, paths)
    found = search(scan(spark, [tree]), "ext:md", 10).collect()
    assert [r.path for r in found] == [tree + "/a/b/y.md"]


def test_ignore_files_in_every_folder(spark, tree, tmp_path, monkeypatch):
    (tmp_path / "tree/a/b/c").mkdir()
    for name in ("a/b/c/z.tmp", "a/b/w.tmp", "a/b/global.x", "a/v.tmp", "q/only.txt"):
        (tmp_path / "tree" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "tree" / name).write_text(name)
    (tmp_path / "tree/.ignore").write_text("*.tmp\n")
    (tmp_path / "tree/a/b/.gitignore").write_text("!z.tmp\n/y.md\n")
    (tmp_path / "tree/q/.ignore").write_text("*\n")
    assert names(scan(spark, [tree]), tree) == ["a/b/c/z.tmp", "a/b/global.x", "a/keep.log", "a/link.txt", "a/x.txt"]
    (tmp_path / "git").mkdir()
    (tmp_path / "git/ignore").write_text("global.x\n")
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    monkeypatch.setenv("HOME", str(tmp_path / "nobody"))
    reader = FsMetaReader({"roots": tree})
    got = sorted(row[3].removeprefix(tree + "/") for part in reader.partitions() for row in reader.read(part))
    assert "a/b/global.x" not in got and "a/b/c/z.tmp" in got
    assert IgnoreFilter([tree]).ignores(tree + "/deep/er/global.x")
    (tmp_path / "nobody").mkdir()
    (tmp_path / "own").write_text("*.md\n")
    (tmp_path / "nobody/.gitconfig").write_text(f"[user]\n name = x\n[core]\n\texcludesFile = {tmp_path}/own\n")
    assert IgnoreFilter([tree]).ignores(tree + "/a.md") and not IgnoreFilter([tree]).ignores(tree + "/global.x")


def test_one_deep_folder_is_read_by_many_tasks(tmp_path, monkeypatch):
    monkeypatch.setattr(fsscan, "SPREAD", 12)
    for i in range(30):
        (tmp_path / f"only/one/{i}").mkdir(parents=True)
        (tmp_path / f"only/one/{i}/f").write_text("")
    os.symlink(tmp_path / "only", tmp_path / "only/one/0/loop")
    reader = FsMetaReader({"roots": str(tmp_path), "follow_links": "true"})
    rows = [sorted(r[3] for r in reader.read(p)) for p in reader.partitions()]
    assert sum(map(len, rows)) == 30 and max(map(len, rows)) == 1


@pytest.mark.parametrize(
    ("rule", "path", "hit"),
    [("*.log", "a/b.log", True), ("/x", "x", True), ("/x", "a/x", False), ("a/**/z", "a/b/c/z", True), ("a/**/z", "a/z", True), ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("d?e", "d/e", False), ("\\#x", "#x", True), ("x\\ ", "x ", True)],
)
def test_rules(rule, path, hit):
    assert bool(parse_rule(rule).regex.match(path)) == hit


def test_ignore_column(spark, tree):
    f = IgnoreFilter([tree])
    df = spark.createDataFrame([(tree + "/a/skip.log",), (tree + "/a/keep.log",), ("/else/skip.log",)], "path string")
    assert [r[0] for r in df.select(f.column()).collect()] == [True, False, False]
    assert parse_rule("# no") is None and parse_rule("  ") is None


def test_ignore_column_without_negation_is_a_regular_expression(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("*.log\nbuild/\n/top\n[xy]?z\n")
    f = IgnoreFilter([str(tmp_path)])
    paths = [f"{tmp_path}/{p}" for p in ("a.log", "a.logs", "build", "build/x", "b/build/y", "top", "b/top", "top/x", "d/xaz", "zaz")] + ["/else/a.log"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("i", f.column())
    assert {r.path: r.i for r in df.collect()} == {p: f.ignores(p) for p in paths}
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('roots = ["/a"]\nexclude_dirs = ["mine"]\ndebounce_ms = 7\nunknown = 1\n')
    c = config.load(str(p), debounce_ms=9, hidden=None)
    assert c.roots == ("/a",) and "mine" in c.exclude_dirs and "node_modules" in c.exclude_dirs and c.debounce_ms == 9 and c.extra == {"unknown": 1}
    assert config.load(str(tmp_path / "none")) == config.Config()


def files(spark, *paths):
    return with_key(spark.createDataFrame([(p, i + 1, 1) for i, p in enumerate(paths)], "path string, ino long, size long")).select("dev", "ino", "generation", "path", "size")


def log(spark, *rows):
    return spark.createDataFrame([(*r, T0) for r in rows], "seq long, event_type string, path string, from_path string, ino long, size long, ts timestamp")


def shown(df):
    return sorted(r.path for r in df.collect())


def test_snapshot_cycle(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    assert s.current() is None and not s.trusted()
    assert s.write(files(spark, "/a", "/b"), expect=[]) == 1
    s.append(log(spark, (1, "delete", "/a", None, 1, 1), (2, "create", "/c", None, 9, 1)))
    assert shown(s.current()) == ["/b", "/c"]
    assert s.compact() == 2 and s.replay(s.load()[2]) is None
    assert shown(s.current()) == ["/b", "/c"]
    with pytest.raises(ConflictError):
        s.write(files(spark, "/z"), expect=[1])
    s.save_state(True)
    assert s.trusted()
    assert s.cutoff_ns() >= 1_700_000_000 * 10**9
    s.reset()
    assert s.current() is None and s.cutoff_ns() == 0 and s.store.names("versions") == []
    s.append(log(spark, (3, "create", "/n", None, 1, 1)))
    assert shown(s.current()) == ["/n"] and normal_roots(["/b/", "/a", "/cafe\u0301", "/a"]) == ["/", "/a", "/b", "/caf\u00e9"]


def test_damaged_version_falls_back(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    s.write(files(spark, "/old"))
    s.write(files(spark, "/new"))
    part = next((tmp_path / "s/versions/2").glob("part-*"))
    part.write_bytes(part.read_bytes()[:-20])
    assert shown(s.current()) == ["/old"]
    other = Snapshots(spark, str(tmp_path / "s"), ["/else"])
    assert other.current() is None
    s.store.write_json("versions/9.json", {})
    s.clean()
    assert "9.json" not in s.store.names("versions")


def test_rebuild_keeps_later_events(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    s.append(log(spark, (1, "create", "/gone", None, 5, 1)))
    begun = s.seal()
    s.append(log(spark, (2, "create", "/late", None, 6, 1)))
    s.rebuild(lambda: files(spark, "/a"), begun)
    assert shown(s.current()) == ["/a", "/late"]


def test_policies():
    assert should_flush(250_000, 0) and should_flush(0, 64 << 20) and not should_flush(10, 10)
    assert should_snapshot(4096, 0, 10) and not should_snapshot(4096, 0, 9) and not should_snapshot(10, 10, 99)


@pytest.mark.parametrize("splits", [1, 3])
def test_stream_equals_batch(spark, tmp_path, splits):
    rows = [(1, "create", "/a", None, 1, 1), (2, "create", "/b", None, 2, 1), (3, "rename", "/c", "/b", 2, 1), (4, "delete", "/a", None, 1, 1), (5, "create", "/node_modules/x", None, 3, 1), (6, "modify", "/a", None, 4, 1)]
    source = tmp_path / "in"
    for i in range(splits):
        log(spark, *rows[i * 6 // splits : (i + 1) * 6 // splits]).coalesce(1).write.mode("append").parquet(str(source))
    snaps = Snapshots(spark, str(tmp_path / "s"))
    p = Pipeline(snaps, flush=lambda n, _: n >= 4)
    stream = spark.readStream.schema(log(spark, rows[0]).schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = p.start(stream, str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    want = apply_events(files(spark, "/zz").limit(0), log(spark, *[r for r in rows if "node_modules" not in r[2]]))
    assert shown(snaps.current()) == shown(want) == ["/a", "/c"]


def test_rename_pairing_across_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "seq long, ts timestamp, event_type string, path string, cookie long"
    for rows in ([(1, T0, "rename_from", "/a", 7), (2, T0, "create", "/n", None)], [(3, T0 + dt.timedelta(seconds=1), "rename_to", "/b", 7), (4, T0, "rename_to", "/x", 8)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = pair_renames_in_state(stream).writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert q.awaitTermination(120)
    got = {(r.event_type, r.path, r.from_path) for r in spark.table("pairs").collect()}
    assert got == {("create", "/n", None), ("rename", "/b", "/a"), ("modify", "/x", None)}


def test_stream_with_renames_across_batches_equals_batch(spark, tmp_path):
    """Pairing, discovery, ignore rules, the cap and the gate, all by way of the pipeline."""
    (tmp_path / "root").mkdir()
    (tmp_path / "root/.gitignore").write_text("*.tmp\n")
    root = str(tmp_path / "root")
    schema = "seq long, ts timestamp, event_type string, path string, cookie long, dev long, ino long, generation int, size long, is_dir boolean"
    big = 2**61 + 1
    rows = [
        (1, "create", "a", None, 1, 1), (2, "create", "x.tmp", None, 9, 1), (3, "rename_from", "a", 7, 1, 1), (4, "create", "d", None, 50, None),
        (5, "rename_to", "b", 7, big, 1), (6, "create", "c", None, 3, 1), (7, "rename_to", "lone", 8, 4, 1), (8, "delete", "c", None, 3, 1), (9, "create", "last", None, 6, None),
    ]
    rows = [(s, T0 + dt.timedelta(seconds=s), kind, f"{root}/{path}", cookie, 1, ino, 0, size, path == "d") for s, kind, path, cookie, ino, size in rows]
    source = str(tmp_path / "in")
    for part in (rows[:4], rows[4:7], rows[7:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    found = lambda dirs: spark.createDataFrame([(1, 60, 0, f"{d}/new", 5) for d in dirs], "dev long, ino long, generation int, path string, size long")
    snaps = Snapshots(spark, str(tmp_path / "s"))
    p = Pipeline(snaps, pair=True, ignore=IgnoreFilter([root]), scan_dirs=found, most_paths=3, periodic=lambda *_: False)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    assert p.start(stream, str(tmp_path / "ck"), once=True, priority=True).awaitTermination(180)
    now = {r.path.removeprefix(root + "/"): r.ino for r in snaps.current().collect()}
    assert now == {"b": big, "d/new": 60, "lone": 4} and p.counts["compactions"] >= 1
    # a batch that a snapshot has taken in is not applied again
    p._compact(2)
    before = snaps.manifest()
    p.apply(spark.createDataFrame(rows[:1], schema), 2)
    assert snaps.replay(snaps.load()[2]) is None and snaps.manifest() == before
    # counters go on where the log stands
    p.apply(spark.createDataFrame(rows[5:6], schema), 3)
    assert Pipeline(snaps).paths == 1


def test_more_new_directories_than_are_read_at_once_call_for_a_rebuild(spark, tmp_path):
    batch = spark.createDataFrame([(n, T0, "create", f"/d{n}", None, 1, n, 0, None, True) for n in range(12)], "seq long, ts timestamp, event_type string, path string, cookie long, dev long, ino long, generation int, size long, is_dir boolean")
    now = [0.0]
    whole = lambda: files(spark, "/all/a", "/all/b")
    p = Pipeline(Snapshots(spark, str(tmp_path / "s")), scan_dirs=lambda dirs: whole().where("false"), rebuild=whole, clock=lambda: now[0], periodic=lambda *_: False)
    p.apply(batch, 0)
    p.apply(batch, 1)
    assert p.counts["rebuilds"] == 1 and p.gate.asked and shown(p.snapshots.current()) == ["/all/a", "/all/b"]
    now[0] = 61.0
    p.apply(batch.limit(0), 2)
    assert p.counts["rebuilds"] == 2


def test_log_with_a_damaged_file(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    s.append(log(spark, (1, "create", "/a", None, 1, 1)).coalesce(1))
    s.append(log(spark, (2, "create", "/b", None, 2, 1)).coalesce(1))
    part = sorted((tmp_path / "s/wal/seal=1").glob("part-*"))[0]
    whole, damaged = s.recover(0)
    assert whole.count() == 2 and damaged == 0
    crc = part.with_name(f".{part.name}.crc")
    crc.unlink()
    data = bytearray(part.read_bytes())
    data[4:60] = bytes(56)
    part.write_bytes(bytes(data))
    rows, damaged = s.recover(0)
    assert damaged == 1 and rows.count() == 1


def test_discovery_and_rebuild_gate(spark):
    batch = spark.createDataFrame([("create", "/d", True), ("create", "/f", False), ("delete", "/g", True)], "event_type string, path string, is_dir boolean")
    found, whole = discovered(batch, lambda dirs: spark.createDataFrame([(d + "/x",) for d in dirs], "path string"))
    assert whole and [(r.path, r.event_type) for r in found.collect()] == [("/d/x", "create")]
    assert discovered(batch.where("NOT is_dir"), None) == (None, True)
    gate = RebuildGate(60)
    assert gate.request(0) and not gate.request(1) and gate.finished(5) and not gate.request(30) and gate.request(70)
