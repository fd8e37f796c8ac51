"""Searches over small tables."""

import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathlens.functions import fuzzy
from pathlens.functions.paths import normalize
from pathlens.functions.scoring import score
from pathlens.operators.search import answer, line_request, matching, mode_of, search

NOW = dt.datetime(2024, 3, 1)
PATHS = {
    "/work/VCP/main.rs": 9, "/work/vcp/main.rs": 10, "/work/VCP_server/New Folder/readme.md": 5, "/work/node_modules/VCP_server/New Folder/readme.md": 5,
    "/or/server_1.js": 3, "/or/plugin_1.js": 3, "/or/myserver_1.js": 3, "/tmp/vcptest/test_123": 1, "/tmp/x/attest_123": 1, "/media/十一.jpg": 4, "/media/十一.txt": 4,
    "/s/client/user/search/initials_probe.txt": 2, "/home/u/.bashrc": 1, "/home/u/a.tar.gz": 1, "/home/u/foo.": 1, "/top": 7, "/tmp/café.txt": 2,
    "/lit/100%_done.txt": 6, "/lit/100x_done.txt": 6, "/deep/a/b/c/d/e.txt": 1,
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(p, n, NOW if i % 3 else None) for i, (p, n) in enumerate(PATHS.items())]
    return spark.createDataFrame(rows, "path string, size long, mtime timestamp").cache()


def found(files, query):
    return {r.path for r in matching(files, query).select("path").collect()}


@pytest.mark.parametrize(
    ("query", "inside", "outside"),
    [
        ("vcp main", {"/work/VCP/main.rs", "/work/vcp/main.rs"}, set()), ("VCP main", {"/work/VCP/main.rs"}, {"/work/vcp/main.rs"}), ("case: vcp main", {"/work/vcp/main.rs"}, {"/work/VCP/main.rs"}),
        ('VCP server|plugin !node_modules "New Folder"', {"/work/VCP_server/New Folder/readme.md"}, {"/work/node_modules/VCP_server/New Folder/readme.md"}),
        ("server_1.js|plugin_1.js", {"/or/server_1.js", "/or/plugin_1.js"}, {"/top"}), ("test_*", {"/tmp/vcptest/test_123"}, {"/tmp/x/attest_123"}),
        ("ext:jpg;png 十一", {"/media/十一.jpg"}, {"/media/十一.txt"}), ("pic:十一", {"/media/十一.jpg"}, {"/media/十一.txt"}), ("size:<10b main", {"/work/VCP/main.rs"}, {"/work/vcp/main.rs"}),
        ("wfn:server_1.js", {"/or/server_1.js"}, {"/or/myserver_1.js"}), ("wfn:/or/server_1.js", {"/or/server_1.js"}, {"/or/myserver_1.js"}),
        (r'regex:"^(server|plugin)_1\\.js$"', {"/or/server_1.js", "/or/plugin_1.js"}, {"/or/myserver_1.js"}), ("regex:a(?=b)", set(), {"/top"}),
        ("parent:/OR", {"/or/server_1.js"}, {"/top"}), ("infolder:/", {"/top"}, {"/or/server_1.js"}), ("parent:/or/", set(), {"/or/server_1.js"}), ("depth:1", {"/top"}, {"/or/server_1.js"}),
        ("len:>17", {"/s/client/user/search/initials_probe.txt"}, {"/top"}), ("c/u/s/initials_probe", {"/s/client/user/search/initials_probe.txt"}, {"/top"}),
        ("type:folder", set(), {"/top"}), ("type:file", set(PATHS), set()), ("content:x", set(), {"/top"}), ("café", {"/tmp/café.txt"}, set()), ("?", set(PATHS), set()),
        ("100%", {"/lit/100%_done.txt"}, {"/lit/100x_done.txt"}), ("100%_*", {"/lit/100%_done.txt"}, {"/lit/100x_done.txt"}), ("/deep/*/e.txt", {"/deep/a/b/c/d/e.txt"}, {"/top"}),
        ("ext:gz", {"/home/u/a.tar.gz"}, {"/home/u/.bashrc"}), ("ext:bashrc", set(), {"/home/u/.bashrc"}), ("dm:2024-03-01 top|dm:2024-03-01 vcp", {"/work/vcp/main.rs"}, {"/work/VCP/main.rs"}),
        ("!dm:2024-03-01 VCP main", {"/work/VCP/main.rs"}, set()), ('a "b', set(), {"/top"}),
    ],
)
def test_query(files, query, inside, outside):
    got = found(files, query)
    assert inside <= got and not outside & got


def test_size_sort_and_limits(files):
    rows = search(files, "type:file", 2, sort="size", order="desc").collect()
    assert [r.size for r in rows] == [10, 9]
    assert len(search(files, "type:file", 0).collect()) == 1
    assert search(files, "type:file", 3, candidate_limit=True, sort="size").count() == 3


def test_time_sort_puts_unknown_first(files):
    first = search(files, "type:file", 30, sort="dm").join(files.select("path", "mtime"), "path").select("mtime")
    assert first.where("mtime IS NULL").count() == 7
    paths = [r.path for r in search(files, "type:file", 30, sort="dm").collect()]
    unknown = {r.path for r in files.where("mtime IS NULL").collect()}
    assert set(paths[: len(unknown)]) == unknown
    assert set([r.path for r in search(files, "type:file", 30, sort="dm", order="desc").collect()][-len(unknown) :]) == unknown


def test_path_order_is_by_component(spark):
    df = spark.createDataFrame([("/a-b/x", 1), ("/a/x", 1)], "path string, size long")
    assert [r.path for r in search(df, "x", sort="path").collect()] == ["/a/x", "/a-b/x"]


def one(spark, path, query, mtime=None):
    df = normalize(spark.createDataFrame([(path, 1, mtime)], "path string, size long, mtime timestamp"))
    return df.select(score(query, F.lit(NOW)).alias("s")).first().s


@pytest.mark.parametrize(
    ("path", "query", "want"),
    [
        ("/top", "zz", 99), ("/a/server.rs", "server", 100 + 160 * 2.5 * 2 + 12 - 0.9 - 1), ("/a/node_modules/x.js", "x", (100 + (160 * 2.5 * 2 + 12) - 0.4) * 0.1 - 1.5),
        ("/a/target/x.js", "x", 100 + 812 - 0.4 - 200 - 1.5), ("/a/.cfg/zz.js", "q", 100 - 0.5 - 30 - 1.5), ("/a/.cfg/zz.js", "q.", 100 - 0.5 - 1.5), ("/a/myTest", "test", 100 + 60 * 2.5 + 8 - 0.6 - 1),
    ],
)
def test_scores(spark, path, query, want):
    assert one(spark, path, query) == int(want + 0.5)


def test_recent(spark):
    assert one(spark, "/top", "zz", NOW - dt.timedelta(days=1)) == one(spark, "/top", "zz") + 15
    assert one(spark, "/top", "zz", NOW + dt.timedelta(days=1)) == one(spark, "/top", "zz", NOW - dt.timedelta(days=8)) == one(spark, "/top", "zz")


def test_fuzzy_finds_target_among_noise(spark):
    rows = [(f"/noise/file_{i}.txt", 1) for i in range(700)] + [("/docs/main_document_target.txt", 1)]
    df = spark.createDataFrame(rows, "path string, size long")
    assert [r.path for r in search(df, "maindoctarget", 1, mode="fuzzy").collect()] == ["/docs/main_document_target.txt"]


def test_fuzzy_score():
    assert fuzzy.score("abc", "ca") is None and fuzzy.score("xay", "") == 0
    assert fuzzy.score("main_doc", "md") > fuzzy.score("xmxxdx", "md")
    assert fuzzy.score("doc", "doc") > fuzzy.score("d_o_c", "doc")


def test_line_protocol(files):
    r = line_request("q: vcp\nlimit=5\nmode:fuzzy\n")
    assert (r.query, r.limit, r.mode) == ("vcp", 5, "fuzzy")
    assert line_request("x:hello").query == "hello" and line_request(" \n") is None and line_request("q:a\nlimit:0").limit == 2000
    assert set(answer(files, "q:server_1")) == {"/or/server_1.js", "/or/myserver_1.js"}
    with pytest.raises(ValueError):
        mode_of("nope")


def test_fuzzy_mode_ranks_every_match(spark):
    rows = [(f"/a/{n:05d}_xmdtx", 1) for n in range(3000)] + [("/z/mdt", 1)]
    df = spark.createDataFrame(rows, "path string, size long")
    assert search(df, "mdt", 1, mode="fuzzy").first().path == "/z/mdt" == search(df, "mdt", 1).first().path
    assert search(df, "mdt", 1, mode="fuzzy", candidate_limit=True).first().path != "/z/mdt"


@given(st.lists(st.text("abAB/._-1 é", max_size=20), max_size=8), st.text("abA/1é", min_size=1, max_size=5))
def test_scores_of_many_texts_are_those_of_each(texts, pattern):
    assert fuzzy.score_all(texts, pattern).tolist() == [-1 if (s := fuzzy.score(t, pattern)) is None else s for t in texts]
