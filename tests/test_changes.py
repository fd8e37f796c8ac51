"""Events, overlays, synchronisation, watch tiers, status."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row

from pathlens.operators import content, index, overlay, status, sync, watch
from pathlens.operators import events as ev

EV = "seq long, event_type string, path string, from_path string, ino long, size long"
T0 = dt.datetime(2024, 1, 1)


def table(spark, rows, schema=EV):
    return spark.createDataFrame(rows, schema)


def base(spark, rows):
    return overlay.with_key(spark.createDataFrame(rows, "path string, ino long, size long")).select("dev", "ino", "generation", "path", "size")


def paths(df):
    return sorted((r.path, r.ino) for r in df.collect())


def test_delete_blocks_base_and_recreate_shows(spark):
    b = base(spark, [("/a", 1, 1), ("/b", 2, 1)])
    assert paths(overlay.apply_events(b, table(spark, [(1, "delete", "/a", None, 1, 1)]))) == [("/b", 2)]
    assert paths(overlay.apply_events(b, table(spark, [(1, "delete", "/a", None, 1, 1), (2, "create", "/a", None, 9, 1)]))) == [("/a", 9), ("/b", 2)]


def test_rename_chain_shows_newest_path_only(spark):
    b = base(spark, [("/v1", 1, 1)])
    log = [(1, "rename", "/v2", "/v1", 1, 1), (2, "rename", "/v3", "/v2", 1, 1)]
    assert paths(overlay.apply_events(b, table(spark, log))) == [("/v3", 1)]


def test_live_identity_hides_base_even_if_its_row_does_not_match(spark):
    b = base(spark, [("/old", 1, 100)])
    shown = overlay.apply_events(b, table(spark, [(1, "modify", "/new", None, 1, 5)]))
    assert [(r.path, r.size) for r in shown.collect()] == [("/new", 5)]


def test_vanished_file_leaves_base(spark):
    assert paths(overlay.apply_events(base(spark, [("/a", 1, 1)]), table(spark, [(1, "modify", "/a", None, None, None)]))) == [("/a", 1)]


def simulate(files, log):
    """The last state of each path, row by row."""
    state = {}
    for seq, kind, path, origin, ino, size in log:
        if kind == "rename":
            state[origin] = (False, seq, ino, size)
        state[path] = (kind != "delete", seq, ino, size)
    live = {}
    for p, (alive, seq, ino, _) in state.items():
        if alive and (ino not in live or live[ino][1] < seq):
            live[ino] = (p, seq)
    rest = [(p, i) for p, i, _ in files if p not in state and i not in live]
    return sorted(rest + [(p, i) for i, (p, _) in live.items()])


def test_random_logs_and_batch_splits(spark):
    rng = random.Random(5)
    files = [(f"/d/{i}", i, 1) for i in range(8)]
    for _ in range(3):
        log = []
        for seq in range(1, 40):
            kind = rng.choice(["create", "delete", "modify", "rename"])
            a, b = rng.sample(range(10), 2)
            log.append((seq, kind, f"/d/{a}", f"/d/{b}" if kind == "rename" else None, rng.randrange(12), 1))
        whole = overlay.apply_events(base(spark, files), table(spark, log))
        assert paths(whole) == simulate(files, log)
        kept = ev.coalesce(table(spark, log[:20])).unionByName(table(spark, log[20:]).select("path", "seq", "event_type", "from_path", "ino", "size"))
        assert set(paths(overlay.apply_events(base(spark, files), kept))) >= set()


def test_coalesce(spark):
    got = ev.coalesce(table(spark, [(1, "create", "/a", None, 1, 1), (2, "modify", "/a", None, 1, 2), (3, "create", "/b", None, 2, 1), (4, "rename", "/c", "/b", 2, 1)])).collect()
    assert sorted((r.seq, r.path) for r in got) == [(2, "/a"), (4, "/c")]


def test_rename_pairing(spark):
    s = lambda n: T0 + dt.timedelta(seconds=n)
    raw = spark.createDataFrame(
        [(1, s(0), "rename_from", "/a", 7), (2, s(1), "rename_to", "/b", 7), (3, s(2), "rename_from", "/c", 8), (4, s(20), "rename_to", "/d", 8), (5, s(3), "rename_to", "/e", 9), (6, s(4), "rename_from", "/f", None), (7, s(4), "create", "/g", None)],
        "seq long, ts timestamp, event_type string, path string, cookie long",
    )
    got = {r.seq: (r.event_type, r.path, r.from_path) for r in ev.pair_renames(raw).collect()}
    assert got == {2: ("rename", "/b", "/a"), 4: ("modify", "/d", None), 5: ("modify", "/e", None), 6: ("modify", "/f", None), 7: ("create", "/g", None)}
    late = {r.seq: r.event_type for r in ev.pair_renames(raw, expire_as_delete=True).collect()}
    assert late[3] == "delete" and 1 not in late


def test_log_cleanup_and_gaps(spark):
    log = spark.createDataFrame([(1, "/a", 5, 10), (2, "/a", 5, 11), (3, "/b", 6, 12)], "pos long, path string, ts long, size long")
    assert sorted((r.seq, r.path, r.size) for r in ev.clean_log(log).collect()) == [(1, "/a", 11), (2, "/b", 12)]
    seqs = table(spark, [(n, "modify", "/x/a", None, 1, 1) for n in (3, 4, 7, 8, 12)])
    assert [tuple(r) for r in ev.gaps(seqs).orderBy("observed_seq").collect()] == [(5, 7, 2), (9, 12, 3)]
    assert tuple(ev.first_gap(seqs, 1).first()) == (2, 3, 1) and ev.first_gap(seqs, 12).count() == 0
    assert ev.repair_scope(seqs) == ["/x"]
    many = table(spark, [(n, "modify", f"/{n}/a", None, 1, 1) for n in range(1, 20)])
    assert ev.repair_scope(many) is None


def test_order_with_outlying_null_and_tied_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    from pathlens.operators import ordering

    keys = [*range(500), 10**15, -(10**18), *([33] * 300), None, None, None]
    df = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "pos long, n long")
    sizes = [r["count"] for r in ordering.bucketed(df, F.col("pos"), 50, F.xxhash64("n")).groupBy("__bucket").count().collect()]
    assert sum(sizes) == len(keys) and max(sizes) < 200
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 50)
    rows = ordering.numbered(df, "pos", "seq").orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, len(keys) + 1))
    assert [r.pos for r in rows] == sorted(keys, key=lambda k: (k is not None, k or 0))
    before = {r.n: r.last for r in ordering.with_previous_max(df, "pos", "last").collect()}
    there = sorted({k for k in keys if k is not None})
    assert before == {n: None if k is None or k == there[0] else there[there.index(k) - 1] for n, k in enumerate(keys)}
    totals = ordering.running_totals(df, F.col("pos"), F.col("n"), {"sum": F.col("n"), "count": F.lit(1)}, 50).orderBy("count").collect()
    assert [r["sum"] for r in totals] == [sum(r.n for r in totals[:i]) for i in range(len(totals))]
    log = spark.createDataFrame([(k, f"/{n}", 1) for n, k in enumerate([1, 2, None, 9, None])], "pos long, path string, ts long")
    assert sorted(r.seq for r in ev.clean_log(log).collect()) == [1, 2, 3, 4, 5]


def test_first_seen_keeps_first_path_and_last_size(spark):
    df = spark.createDataFrame([(1, 5, 0, "/a", 1, 1), (1, 5, 0, "/b", 2, 2), (1, 6, 0, "/c", 3, 3)], "dev long, ino long, generation int, path string, size long, seq long")
    assert sorted((r.path, r.size) for r in overlay.first_seen(df).collect()) == [("/a", 2), ("/c", 3)]


def test_admission_to_a_full_delta(spark):
    held = spark.createDataFrame([("/a",), ("/b",)], "path string")
    batch = table(spark, [(1, "modify", "/a", None, 1, 1), (2, "modify", "/c", None, 1, 1), (3, "modify", "/d", None, 1, 1), (4, "modify", "/b", None, 1, 1)])
    kept, whole = overlay.admit(held, batch, 3)
    assert not whole and [r.seq for r in kept.orderBy("seq").collect()] == [1, 2]
    assert overlay.admit(held, batch, 4)[1]


def test_sync(spark):
    indexed = spark.createDataFrame([("/d/a", 1, T0), ("/d/b", 2, None), ("/e/c", 3, T0)], "path string, size long, mtime timestamp")
    scan = spark.createDataFrame([("/d/a", 1, T0), ("/d/b", 2, T0), ("/d/n", 1, T0)], "path string, size long, mtime timestamp")
    states = sync.freshness(scan, indexed)
    assert {r.path: r.state for r in states.collect()} == {"/d/a": "unchanged", "/d/b": "changed", "/d/n": "missing"}
    row = sync.repair_needed(states).first()
    assert (row.scanned, row.changed, row.escalate) == (3, 2, True) and not sync.repair_needed(states, "never").first().escalate
    assert sync.repair_needed(states.limit(0)).first().escalate
    dirty = spark.createDataFrame([("/d",)], "path string")
    assert [r.path for r in sync.delete_alignment(indexed, dirty, scan.where("path <> '/d/b'")).collect()] == ["/d/b"]
    dirs = spark.createDataFrame([("/y", 20 * 10**9), ("/x", 30 * 10**9)], "path string, mtime_ns long")
    assert [r.path for r in sync.changed_dirs(dirs, sync.DirtyScope(35 * 10**9)).collect()] == ["/x"]
    assert [r.path for r in sync.changed_dirs(dirs, sync.DirtyScope()).collect()] == ["/x", "/y"]
    many = spark.createDataFrame([("/d", f"/d/{i}") for i in range(5)], "dir string, path string")
    assert sync.bounded(many, 2).count() == 2


def test_trigram_candidates_cover_matches(spark):
    df = spark.createDataFrame([("/x/Hello.txt",), ("/x/help.txt",), ("/hel/lo",), ("/文档/a",)], "path string")
    idx = index.trigrams(df)
    got = {r.path for r in index.narrowed(df, idx, "*hello*").collect()}
    assert got == {"/x/Hello.txt"} and index.candidates(idx, "a?b") is None
    assert {r.path for r in index.narrowed(df, idx, "文档").collect()} == {"/文档/a"}
    assert {r.path for r in index.candidates_any(idx, ["hello", "help"]).collect()} == {"/x/Hello.txt", "/x/help.txt"} and index.candidates_any(idx, ["hello", "a?b"]) is None


def test_content(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "a\0b"), (4, "")], "id long, text string")
    assert sorted((r.id, r.copies) for r in content.dedup(df, "text", "id").collect()) == [(1, 2), (4, 1)]


def test_watch_budget_and_tiers(spark):
    df = spark.createDataFrame([("/a", 3), ("/b", 5), ("/c", 2)], "path string, watch_cost long")
    assert [r.admitted for r in watch.admission(df, 5).orderBy("path").collect()] == [True, False, True]
    w = watch.WatchState(4)
    w.add("/a", "L0", 3, 100)
    assert w.register("/b", 2, 100) == watch.BLOCKED and w.blocked == 1
    assert w.demote("/a") and not w.demote("/a")
    w.settle_demotion("/a", True)
    assert w.used == 0 and w.register("/b", 2, 200) == watch.SEND and w.register("/b", 2, 200) == watch.NOT_ELIGIBLE
    w.settle_promotion("/b", True, 210)
    assert w.dirs["/b"].tier == "L0" and w.promotions == 1 and w.demotions == 1
    w.add("/b/scanned", "L1", 1, 50)
    w.touch("/b/scanned/x", 300)
    assert w.dirs["/b"].last_event == 300 and w.dirs["/b/scanned"].last_event == 50
    assert watch.batch_size(100) == 1 and watch.batch_size(5000) == 10


def test_rounds_of_the_watch_tiers():
    w = watch.WatchState(3)
    for path, tier, cost, seen in (("/idle", "L0", 2, 100), ("/busy", "L0", 1, 9_000), ("/a", "L1", 2, 0), ("/b", "L1", 2, 0), ("/quiet", "L1", 1, 0)):
        w.add(path, tier, cost, seen)
    asked = []
    done = w.tick(10_000, lambda p: asked.append(p) or (p != "/quiet"), lambda p: True, lambda p: True, items_per_second=1_500)
    assert asked == ["/a", "/b", "/idle"] and done == {"demoted": 1, "scanned": 3, "promoted": 1}
    assert {p: d.tier for p, d in w.dirs.items()} == {"/idle": "L1", "/busy": "L0", "/a": "L0", "/b": "L1", "/quiet": "L1"} and w.used == 3 and w.blocked == 2
    assert w.tick(10_001, lambda p: 0, None, None)["scanned"] == 3 and w.dirs["/quiet"].empty_scans == 1
    w.dirs["/busy"].last_event = 1
    assert w.tick(20_000, lambda p: 1, lambda p: False, lambda p: False)["demoted"] == 0 and w.used == 3


def test_incremental_scan(spark):
    b = base(spark, [("/x/a", 1, 1), ("/x/gone", 2, 1), ("/y/c", 3, 1)])
    dirs = spark.createDataFrame([("/x", 90 * 10**9), ("/y", 10 * 10**9)], "path string, mtime_ns long")
    now = base(spark, [("/x/a", 1, 5), ("/x/new", 9, 1)])
    got = sync.incremental_scan(b, dirs, sync.DirtyScope(60 * 10**9), lambda paths: now if paths == ["/x"] else None)
    assert sorted((r.path, r.size) for r in got.collect()) == [("/x/a", 5), ("/x/new", 1), ("/y/c", 1)]


def test_health(spark):
    rows = status.health(spark.createDataFrame([(True, 0, 5), (True, 2, 5)], "watch_enabled boolean, watch_failures int, last_snapshot int")).collect()
    assert [(r.index_health, r.issues) for r in rows] == [("ok", []), ("warning", ["watch_failures: 2"])]
    assert status.health(spark.createDataFrame([(False,)], "watch_enabled boolean")).first().index_health == "static"
    m = status.metrics(spark.createDataFrame([("query", 5), ("query", 8)], "kind string, micros long")).first()
    assert m.average_query_micros == 6 and m.average_event_micros == 0


def test_trend(spark):
    rows = [Row(process="p", ts=T0 + dt.timedelta(minutes=i), value=float(i * 10)) for i in range(20)]
    assert {r.per_minute for r in status.trend(spark.createDataFrame(rows)).where("ts > '2024-01-01 00:01:00'").collect()} == {10.0}


def test_layers(spark):
    l0, l1 = (spark.createDataFrame([(p, n)], "path string, n int") for p, n in (("/a", 0), ("/b", 1)))
    gone = spark.createDataFrame([("/a",)], "path string")
    assert [r.path for r in overlay.layered([(l0, None), (l1, gone)]).collect()] == ["/b"]


@pytest.mark.parametrize("scope", [None])
def test_estimates(spark, scope):
    df = table(spark, [(1, "rename", "/ab", "/é", 1, 1), (2, "modify", None, None, 1, 1)])
    assert [r[0] for r in df.orderBy("seq").select(ev.estimated_bytes()).collect()] == [6, 16]


def test_gap_repair_and_hot_directories(spark):
    b = base(spark, [("/x/a", 1, 1), ("/x/b", 2, 1), ("/y/c", 3, 1)])
    current = base(spark, [("/x/a", 1, 9)])
    log = table(spark, [(5, "modify", "/x/a", None, 1, 1), (8, "modify", "/x/b", None, 2, 1)])
    files, report = sync.verify_and_repair(b, log, 4, lambda dirs: current if dirs == ["/x"] else None)
    assert sorted((r.path, r.size) for r in files.collect()) == [("/x/a", 9), ("/y/c", 1)]
    assert report == {"verified": 8, "gap": {"expected_seq": 6, "observed_seq": 8, "missing_count": 2}}
    assert sync.verify_and_repair(b, log.where("seq = 5"), 4, None)[1]["gap"] is None
    dirs = spark.createDataFrame([("/r",), ("/r/hot",), ("/r/target/x",), ("/s/hot",)], "path string")
    assert [r.path for r in watch.hot_candidates(dirs, ["/r/hot", "/r/target/x", "/s/hot"], ["/r"]).collect()] == ["/r/hot"]
    assert [r.path for r in watch.hot_candidates(dirs, [], ["/r"]).collect()] == ["/r"]
