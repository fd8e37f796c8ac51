"""Queries over the sample tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlens import fixtures
from pathlens.functions import fuzzy, highlight, scoring
from pathlens.functions.exclude import excluded
from pathlens.functions.paths import longest_root, normalize
from pathlens.operators import content, events, index, overlay, status, sync, watch
from pathlens.operators import search as searching

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NAMED = f"""
WITH raw AS ({fixtures.FILES_DUCKDB}),
n AS (SELECT *, {_FOLD.format("path")} AS path_fold, regexp_extract(path, '([^/]+)/*$', 1) AS name, regexp_extract(path, '^(.*)/[^/]+$', 1) AS parent FROM raw),
files AS (SELECT *, {_FOLD.format("name")} AS name_fold, CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN {_FOLD.format("regexp_extract(name, '\\.([^.]*)$', 1)")} END AS ext,
  len(path) - len(replace(path, '/', '')) AS depth, strlen(name) AS name_len, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM n)
"""
AS_OF = "2024-03-01 00:00:00"


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.files(spark, sf_dir)


def _match(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return searching.matching(files(spark, sf_dir), text).select("path", "size")


def add_match(name: str, text: str, where: str) -> None:
    """A query for all matches of ``text``, which are the rows where ``where`` holds."""
    add(name, partial(_match, text), f"{NAMED} SELECT path, size FROM files WHERE {where}")


add_match("text_contains", "cfg_dir", "contains(path_fold, 'cfg_dir')")
add_match("text_smartcase_upper", "VCP_Doc", "contains(path, 'VCP_Doc')")
add_match("text_cjk", "文档", "contains(path_fold, '文档')")
add_match("and_terms", "src1 doc_ 00", "contains(path_fold, 'src1') AND contains(path_fold, 'doc_') AND contains(path_fold, '00')")
add_match("or_branches", "node_modules|mytestfile", "contains(path_fold, 'node_modules') OR contains(path_fold, 'mytestfile')")
add_match("not_exclude", "doc_ !node_modules !ext:md", "contains(path_fold, 'doc_') AND NOT contains(path_fold, 'node_modules') AND NOT coalesce(ext = 'md', false)")
add_match("only_excludes", "!doc_", "NOT contains(path_fold, 'doc_')")
add_match("phrase", '"target/debug" ".rs"', "(contains(path_fold, 'target/debug') AND contains(path_fold, '.rs'))")
add_match("glob_segment", "doc_*.txt", "name_fold LIKE 'doc\\_%.txt' ESCAPE '\\' OR len(list_filter(segs, lambda s: lower(s) LIKE 'doc\\_%.txt' ESCAPE '\\')) > 0")
add_match("glob_dir_segment", "src1?", "len(list_filter(segs, lambda s: lower(s) LIKE 'src1_')) > 0")
add_match("glob_fullpath", "/corpus/src?/*.tar.gz", "path_fold LIKE '/corpus/src_/%.tar.gz'")
add_match("wfn_basename", "wfn:doc_000002.pdf", "name_fold = 'doc_000002.pdf'")
add_match("wfn_fullpath", "wfn:/corpus/src1/en/doc_000001.txt", "path_fold = '/corpus/src1/en/doc_000001.txt'")
add_match("regex_basename", r'regex:"^doc_0+[0-9]{1,2}\\."', "regexp_matches(name, '^doc_0+[0-9]{1,2}\\.')")
add_match("regex_fullpath", r'regex:"src[0-3]/(en|fr)/.*\\.md$"', "regexp_matches(path, '(?i)src[0-3]/(en|fr)/.*\\.md$')")
add_match("regex_fallback", r"regex:doc_(?=0)", "contains(path_fold, 'doc_(?=0)') OR name_fold LIKE 'doc\\_(_=0)' ESCAPE '\\' OR len(list_filter(segs, lambda s: lower(s) LIKE 'doc\\_(_=0)' ESCAPE '\\')) > 0")
add_match("ext_filter", "ext:md;.TXT", "ext IN ('md', 'txt')")
add_match("media_doc", "doc:", "ext IN ('txt', 'md', 'markdown', 'pdf', 'doc', 'docx', 'xls', 'xlsx', 'ppt', 'pptx', 'rtf', 'odt', 'ods', 'odp', 'epub', 'csv')")
add_match("media_pic", "pic:doc_", "ext IN ('jpg', 'jpeg', 'png', 'gif', 'bmp', 'webp', 'tif', 'tiff', 'heic', 'heif', 'svg', 'ico') AND contains(path_fold, 'doc_')")
add_match("media_video", "video:", "ext IN ('mp4', 'mkv', 'mov', 'avi', 'webm', 'flv', 'm4v', 'mpg', 'mpeg', 'wmv', '3gp', 'ts')")
add_match("size_ge", "size:2kb", "size >= 2048")
add_match("size_lt", "size:<500b", "size < 500")
add_match("dm_day", "dm:2024-01-15", "mtime >= TIMESTAMP '2024-01-15' AND mtime < TIMESTAMP '2024-01-16'")
add_match("dm_overflow", "dm:2024-02-31", "mtime >= TIMESTAMP '2024-03-02' AND mtime < TIMESTAMP '2024-03-03'")
add_match("dc_absent", "dc:2024-01-15", "false")
add_match("da_absent", "da:2024-01-15", "false")
add_match("parent_filter", "parent:/corpus/SRC2/en", f"{_FOLD.format('parent')} = '/corpus/src2/en'")
add_match("depth_le", "depth:<=4", "depth <= 4")
add_match("name_len_gt", "len:>16", "name_len > 16")
add_match("type_folder_empty", "type:folder", "false")
add_match("type_file_all", "type:file", "true")
add_match("content_placeholder", "content:the", "false")
add_match("path_initials", "c/src1/e/doc", "contains(path_fold, 'c/src1/e/doc') OR regexp_matches(lower(path), '(?:^|/)c[^/]*/(?:.*/)?src1[^/]*/(?:.*/)?e[^/]*/(?:.*/)?[^/]*doc')")
add_match("case_directive", "case: vcp_doc|case: doc_", "contains(path, 'vcp_doc') OR contains(path, 'doc_')")
add_match("legacy_fallback", "a| !b", "contains(path_fold, 'a| !b')")
add_match("exclude_dirs", "!node_modules !target", "NOT contains(path_fold, 'node_modules') AND NOT contains(path_fold, 'target')")

_PART = "regexp_matches(lower(path), '(?:^|[/\\\\])(?:{})(?:$|[/\\\\])')"
_NODE = _PART.format("node_modules|\\.node_modules")
_JUNK = _PART.format("|".join(n.replace(".", "\\.") for n in scoring.JUNK_NAMES))


def score_sql(needle: str, located: bool, dotted: bool, node: bool) -> str:
    """The score for a lower-case needle, as an SQL expression."""
    quoted = needle.replace("\\", "\\\\").replace(".", "\\.").replace("-", "\\-")
    inside = f"contains(lower(name), '{needle}')"
    stem = r"(CASE WHEN contains(lower(name), '.') THEN regexp_extract(lower(name), '(?s)^(.*)\.[^.]*$', 1) ELSE lower(name) END)"
    camel = f"regexp_matches(path, '[a-z]{needle[0].upper()}(?i:{quoted[1:]})')" if needle[0].isalpha() else "false"
    start = f"starts_with(path_fold, '{needle}')"
    total = f"""100.0::DOUBLE + (CASE WHEN {inside} THEN 60.0 ELSE 0.0 END + CASE WHEN {stem} = '{needle}' THEN 60.0 ELSE 0.0 END + CASE WHEN starts_with(lower(name), '{needle}') THEN 40.0 ELSE 0.0 END)::DOUBLE
      * CASE WHEN {inside} THEN 2.5 ELSE 1.0 END * CASE WHEN NOT {start} AND regexp_matches(path_fold, '[./\\\\]{quoted}') THEN 2.0 ELSE 1.0 END
      + CASE WHEN {start} THEN 15.0 WHEN regexp_matches(path_fold, '[/\\\\.\\-_ ]{quoted}') THEN 12.0 WHEN {camel} THEN 8.0 ELSE 0.0 END
      - name_len * 0.1::DOUBLE + CASE WHEN mtime <= TIMESTAMP '{AS_OF}' AND mtime > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN 15.0 ELSE 0.0 END"""
    if located:
        return f"CAST(round({total}) AS BIGINT)"
    hidden = "0.0" if dotted else f"CASE WHEN regexp_matches(path, '(?:^|[/\\\\])\\.[^/\\\\]+[/\\\\]') AND NOT {inside} THEN 30.0 ELSE 0.0 END"
    base = f"(({total}) - {hidden})"
    noisy = f"CASE WHEN {_JUNK} AND NOT {_NODE} THEN {base} - 200.0 ELSE {base} END"
    zoned = noisy if node else f"CASE WHEN {_NODE} THEN (CASE WHEN {base} > 0 THEN {base} * 0.1::DOUBLE ELSE {base} END) ELSE {noisy} END"
    return f"CAST(round(({zoned}) - depth * 0.5::DOUBLE) AS BIGINT)"


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _scores(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(files(spark, sf_dir)).select("path", scoring.score(text, _as_of()).alias("score"))


add("score_values", partial(_scores, "vcp_doc"), f"{NAMED} SELECT path, {score_sql('vcp_doc', False, False, False)} AS score FROM files")
add("score_values_camel", partial(_scores, "testfile"), f"{NAMED} SELECT path, {score_sql('testfile', False, False, False)} AS score FROM files")
add("score_values_located", partial(_scores, "en/doc_"), f"{NAMED} SELECT path, {score_sql('doc_', True, False, False)} AS score FROM files")
add("score_values_node", partial(_scores, "node_modules"), f"{NAMED} SELECT path, {score_sql('node_modules', False, False, True)} AS score FROM files")


def _search(text: str, limit: int, options: dict, spark: SparkSession, sf_dir: str) -> DataFrame:
    return searching.search(files(spark, sf_dir), text, limit, as_of=_as_of(), **options).select("path", "size", "score")


def add_search(name: str, text: str, limit: int, where: str, score: str, by: str, **options) -> None:
    add(name, partial(_search, text, limit, options), f"{NAMED} SELECT path, size, {score} AS score FROM files WHERE {where} ORDER BY {by} LIMIT {limit}")


_KEY = "string_split(path, '/')"
_DOC, _DOC_SCORE = "contains(path_fold, 'doc_')", score_sql("doc_", False, False, False)
add_search("score_topk", "doc_", 50, _DOC, _DOC_SCORE, f"score DESC, {_KEY}")
add_search("sort_name", "doc_", 40, _DOC, _DOC_SCORE, f"lower(name), {_KEY}", sort="name")
add_search("sort_path_desc", "doc_", 40, _DOC, _DOC_SCORE, f"{_KEY} DESC", sort="path", order="desc")
add_search("sort_size_desc", "doc_", 40, _DOC, _DOC_SCORE, f"size DESC, {_KEY} DESC", sort="size", order="desc")
add_search("sort_ext", "doc_", 40, _DOC, _DOC_SCORE, f"coalesce(ext, ''), {_KEY}", sort="ext")
add_search("sort_mtime_nulls", "doc_", 40, _DOC, _DOC_SCORE, f"mtime NULLS FIRST, {_KEY}", sort="dm")
add_search("sort_mtime_desc", "doc_", 40, _DOC, _DOC_SCORE, f"mtime DESC NULLS LAST, {_KEY} DESC", sort="modified", order="desc")


def _highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = searching.matching(files(spark, sf_dir), "doc_0")
    return found.select("path", highlight.highlights("doc_0").alias("h")).select("path", F.array_join(F.transform("h", lambda r: F.concat_ws("-", r["start"], r["end"])), ",").alias("ranges"))


add("highlight_substring", _highlights, f"""{NAMED} SELECT path, array_to_string(list_transform(
  list_filter(range(0, len(path)), lambda i: substr(lower(path), i + 1, 5) = 'doc_0'),
  lambda i: strlen(substr(path, 1, i)) || '-' || (strlen(substr(path, 1, i)) + 5)), ',') AS ranges FROM files WHERE contains(path_fold, 'doc_0')""")


def _fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searching.search(files(spark, sf_dir), "mtstfl", 50, mode="fuzzy", as_of=_as_of()).select("path", "size", "score")


add("fuzzy_topk", _fuzzy)
add("fuzzy_candidates", lambda s, d: normalize(files(s, d)).where(fuzzy.may_match("mtstfl")).select("path"), f"{NAMED} SELECT path FROM files WHERE lower(path) LIKE '%m%t%s%t%f%l%'")


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with times of creation and access."""
    return files(spark, sf_dir).withColumn("ctime", F.expr("mtime + INTERVAL '36' HOUR")).withColumn("atime", F.expr("CASE WHEN size % 5 > 0 THEN mtime + INTERVAL '100' HOUR END"))


_TIMED = NAMED + ", timed AS (SELECT *, mtime + INTERVAL 36 HOUR AS ctime, CASE WHEN size % 5 > 0 THEN mtime + INTERVAL 100 HOUR END AS atime FROM files)"
for _name, _text, _where in (
    ("dc_day", "dc:2024-01-15", "ctime >= TIMESTAMP '2024-01-15' AND ctime < TIMESTAMP '2024-01-16'"),
    ("da_day", "da:2024-01-15", "atime >= TIMESTAMP '2024-01-15' AND atime < TIMESTAMP '2024-01-16'"),
    ("da_not_day", "doc_ !da:2024-01-15", "contains(path_fold, 'doc_') AND NOT coalesce(atime >= TIMESTAMP '2024-01-15' AND atime < TIMESTAMP '2024-01-16', false)"),
):
    add(_name, lambda s, d, text=_text: searching.matching(_timed(s, d), text).select("path", "size"), f"{_TIMED} SELECT path, size FROM timed WHERE {_where}")
for _name, _by, _sort, _order in (("sort_ctime_desc", f"ctime DESC NULLS LAST, {_KEY} DESC", "dc", "desc"), ("sort_atime_nulls", f"atime NULLS FIRST, {_KEY}", "accessed", None)):
    add(_name, lambda s, d, sort=_sort, order=_order: searching.search(_timed(s, d), "doc_", 40, sort=sort, order=order, as_of=_as_of()).select("path", "size", "score"), f"{_TIMED} SELECT path, size, {_DOC_SCORE} AS score FROM timed WHERE {_DOC} ORDER BY {_by} LIMIT 40")


# Changes and maintenance.

EVENTS = f"WITH ev AS ({fixtures.FS_EVENTS})"
_STATES = EVENTS + """,
st AS (SELECT path, seq, event_type <> 'delete' AS live, false AS gone, ino, size FROM ev
  UNION ALL SELECT from_path, seq, false, true, ino, size FROM ev WHERE event_type = 'rename' AND from_path IS NOT NULL)"""


def _latest_sql(where: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS rn FROM st WHERE {where}) WHERE rn = 1)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.fs_events(spark, sf_dir)


def _delta_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.delta(_events(spark, sf_dir)).select("path", "seq", "live", "ino", "size")


def _event_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.coalesce(_events(spark, sf_dir)).select("seq", "event_type", "path", "from_path")


def _wal_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _events(spark, sf_dir).select("path", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), "size", F.col("seq").alias("pos"))
    return events.clean_log(records).select("seq", "path", "size")


def _raw_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "delete", "rename_from").when(F.col("event_type") == "rename", "rename_to").otherwise(F.col("event_type"))
    cookie = F.when(F.col("event_type").isin("delete", "rename"), F.expr("ino div 70"))
    return _events(spark, sf_dir).select("seq", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, seq % 5000)").alias("ts"), kind.alias("event_type"), "path", cookie.alias("cookie"))


def _rename_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.pair_renames(_raw_moves(spark, sf_dir), 600).select("seq", "event_type", "path", "from_path")


def _base_and_delta(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = overlay.with_key(_events(spark, sf_dir))
    base = events.delta(every.where("seq <= 5000")).where("live").select("dev", "ino", "generation", "path", "size")
    return overlay.first_seen(base.withColumn("seq", F.lit(0)).withColumn("seq", F.crc32("path"))).select("dev", "ino", "generation", "path", "size"), events.delta(every.where("seq > 5000"))


def _visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.visible_files(*_base_and_delta(spark, sf_dir)).select("path", "ino", "size")


def _visible_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searching.matching(overlay.visible_files(*_base_and_delta(spark, sf_dir)), "f3 size:<50 !u1").select("path", "size")


_VISIBLE = _STATES + f""",
b0 AS (SELECT path, ino, size FROM {_latest_sql("seq <= 5000")} WHERE live),
base AS (SELECT path, ino, size FROM b0),
d AS (SELECT * FROM {_latest_sql("seq > 5000")}),
live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ino ORDER BY seq DESC) AS k FROM d WHERE live) WHERE k = 1),
visible AS (SELECT path, ino, size FROM base WHERE path NOT IN (SELECT path FROM d) AND ino NOT IN (SELECT ino FROM live) UNION ALL SELECT path, ino, size FROM live)"""


def _first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    both = rows.withColumn("seq", F.col("ino") * 2).unionByName(rows.withColumn("path", F.concat(F.lit("/alias"), "path")).withColumn("size", F.col("size") + 1).withColumn("seq", F.col("ino") * 2 + 1))
    return overlay.first_seen(both).select("ino", "path", "size")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The files as indexed, and as a later scan finds them."""
    rows = files(spark, sf_dir)
    later = rows.where("ino % 10 <> 3").withColumn("size", F.col("size") + F.when(F.col("ino") % 6 == 0, 1).otherwise(0))
    fresh = rows.where("ino % 9 = 4").withColumn("path", F.concat("path", F.lit(".new"))).withColumn("ino", F.col("ino") + 10_000_000)
    return rows, later.unionByName(fresh)


_SCAN = f"""{NAMED}, scan AS (SELECT path, size + CASE WHEN ino % 6 = 0 THEN 1 ELSE 0 END AS size, parent FROM files WHERE ino % 10 <> 3
  UNION ALL SELECT path || '.new', size, parent FROM files WHERE ino % 9 = 4)"""


def _freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, scan = _halves(spark, sf_dir)
    return sync.freshness(scan, index)


def _repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.repair_needed(_freshness(spark, sf_dir))


def _dirty(index: DataFrame) -> DataFrame:
    return normalize(index).where("parent LIKE '%/en' OR parent LIKE '%/lib'").select(F.col("parent").alias("path")).distinct()


def _delete_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, scan = _halves(spark, sf_dir)
    return sync.delete_alignment(index, _dirty(index), scan)


def _fast_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, scan = _halves(spark, sf_dir)
    dirty = _dirty(index)
    current = normalize(scan).join(dirty.select(F.col("path").alias("parent")), "parent", "left_semi").select(*index.columns)
    return sync.fast_sync(index, dirty, current).select("path", "size")


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.gaps(_events(spark, sf_dir).where("seq % 97 <> 0"))


def _first_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.first_gap(_events(spark, sf_dir).where("seq % 97 <> 0"), 500)


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(files(spark, sf_dir))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    return index.narrowed(rows, index.trigrams(rows), "*testfile*").select("path")


_TRIGRAMS = f"""{NAMED}, seg AS (SELECT path, lower(unnest(segs)) AS s FROM files), h AS (SELECT path, hex(encode(s)) AS h FROM seg),
tri AS (SELECT DISTINCT path, substr(h, i * 2 + 1, 6) AS trigram FROM (SELECT path, h, unnest(range(0, len(h) // 2 - 2)) AS i FROM h))"""


def _dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = index.parent_counts(files(spark, sf_dir))
    n = F.col("children")
    return counts.select(
        F.col("parent").alias("path"), F.when(n % 4 == 0, "L0").when(n % 4 == 3, "L2").otherwise("L1").alias("tier"), n.alias("watch_cost"), (n * 1000).alias("last_event"),
        F.pmod(n, F.lit(7)).alias("last_scan"), (n % 5 == 0).alias("promotion_pending"), (n % 8 == 0).alias("demotion_pending"),
    )


_DIRS = f"""{NAMED}, pc AS (SELECT parent AS path, count(*) AS n FROM files GROUP BY parent),
dirs AS (SELECT path, CASE WHEN n % 4 = 0 THEN 'L0' WHEN n % 4 = 3 THEN 'L2' ELSE 'L1' END AS tier, n AS watch_cost, n * 1000 AS last_event, n % 7 AS last_scan,
  n % 5 = 0 AS promotion_pending, n % 8 = 0 AS demotion_pending FROM pc)"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events(spark, sf_dir).select(F.when(F.col("event_type") == "modify", "query").otherwise("event").alias("kind"), (F.col("size") + 1).alias("micros"))
    return status.metrics(log)


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", "doc_id")


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select("path", "size")
    newer = rows.where("size % 3 = 0").withColumn("size", -F.col("size"))
    return overlay.layered([(rows, None), (newer, rows.where("size % 3 = 1").select("path"))])


def _under_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", longest_root(F.col("path"), ["/corpus", "/corpus/src1", "/corpus/src1/en"]).alias("root"))


def _excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize(files(spark, sf_dir))
    return rows.where(~excluded(F.col("segs"))).select("path", "size")


add("delta_latest_state", _delta_latest_state, f"{_STATES} SELECT path, seq, live, ino, size FROM {_latest_sql('true')}")
add("event_coalesce", _event_coalesce, f"{_STATES} SELECT ev.seq, ev.event_type, ev.path, ev.from_path FROM {_latest_sql('true')} l JOIN ev ON ev.path = l.path AND ev.seq = l.seq WHERE NOT l.gone")
add("wal_dedup", _wal_dedup, f"""{EVENTS}, k AS (SELECT path, date_trunc('day', ts) AS t, max(seq) AS pos FROM ev GROUP BY ALL)
SELECT row_number() OVER (ORDER BY k.pos) AS seq, ev.path, ev.size FROM k JOIN ev ON ev.seq = k.pos""")
_MOVES = EVENTS + """, raw AS (SELECT seq, TIMESTAMP '2024-01-01' + to_seconds(seq % 5000) AS ts, path, CASE WHEN event_type IN ('delete', 'rename') THEN ino // 70 END AS cookie,
  CASE event_type WHEN 'delete' THEN 'rename_from' WHEN 'rename' THEN 'rename_to' ELSE event_type END AS event_type FROM ev),
lagged AS (SELECT *, lag(event_type) OVER w AS k, lag(path) OVER w AS p, lag(ts) OVER w AS t FROM raw WHERE cookie IS NOT NULL WINDOW w AS (PARTITION BY cookie ORDER BY seq)),
tos AS (SELECT seq, path, CASE WHEN k = 'rename_from' AND ts < t + INTERVAL 600 SECOND THEN p END AS from_path FROM lagged WHERE event_type = 'rename_to')"""
add("rename_pairing", _rename_pairing, f"{_MOVES} SELECT seq, event_type, path, NULL AS from_path FROM raw WHERE cookie IS NULL UNION ALL SELECT seq, CASE WHEN from_path IS NULL THEN 'modify' ELSE 'rename' END, path, from_path FROM tos")
add("visible_files", _visible, f"{_VISIBLE} SELECT path, ino, size FROM visible")
add("visible_search", _visible_search, f"{_VISIBLE} SELECT path, size FROM visible WHERE contains(path, 'f3') AND size < 50 AND NOT contains(path, 'u1')")
add("dedup_first_seen", _first_seen, f"{NAMED} SELECT ino, path, size + 1 AS size FROM files")
add("freshness", _freshness, f"{_SCAN} SELECT s.path, CASE WHEN f.path IS NULL THEN 'missing' WHEN f.size = s.size THEN 'unchanged' ELSE 'changed' END AS state FROM scan s LEFT JOIN files f ON f.path = s.path")
add("startup_repair", _repair, f"""{_SCAN}, st AS (SELECT f.path IS NULL OR f.size <> s.size AS c FROM scan s LEFT JOIN files f ON f.path = s.path)
SELECT count(*) AS scanned, count(*) FILTER (c) AS changed, count(*) FILTER (c) / count(*)::DOUBLE AS changed_ratio, count(*) FILTER (c) / count(*)::DOUBLE > 0.3 AS escalate FROM st""")
_DIRTY = "(parent LIKE '%/en' OR parent LIKE '%/lib')"
add("delete_alignment", _delete_alignment, f"{_SCAN} SELECT path FROM files WHERE {_DIRTY} AND path NOT IN (SELECT path FROM scan)")
add("fast_sync", _fast_sync, f"{_SCAN} SELECT path, size FROM files WHERE NOT {_DIRTY} UNION ALL SELECT path, size FROM scan WHERE {_DIRTY}")
_JUMPS = f"{EVENTS}, s AS (SELECT DISTINCT seq FROM ev WHERE seq % 97 <> 0), g AS (SELECT seq, lag(seq) OVER (ORDER BY seq) AS p FROM s)"
add("gap_detect", _gaps, f"{_JUMPS} SELECT p + 1 AS expected_seq, seq AS observed_seq, seq - p - 1 AS missing_count FROM g WHERE seq > p + 1")
add("gap_first", _first_gap, f"{_JUMPS} SELECT p + 1 AS expected_seq, seq AS observed_seq, seq - p - 1 AS missing_count FROM g WHERE seq > p + 1 AND seq > 500 ORDER BY seq LIMIT 1")
add("trigram_postings", _postings, f"{_TRIGRAMS} SELECT trigram, count(*) AS n FROM tri GROUP BY trigram")
add("trigram_candidates", _candidates, f"{_TRIGRAMS} SELECT path FROM tri WHERE trigram IN ('746573', '657374', '737466', '746669', '66696C', '696C65') GROUP BY path HAVING count(*) = 6")
add("parent_counts", lambda s, d: index.parent_counts(files(s, d)), f"{NAMED} SELECT parent, count(*) AS children FROM files GROUP BY parent")
add("index_stats", lambda s, d: index.stats(files(s, d)), f"""{NAMED} SELECT count(*) AS file_count, count(DISTINCT parent) AS parents, CAST(sum(strlen(path)) AS BIGINT) AS path_bytes,
  CAST(sum(size) AS BIGINT) AS total_size, count(*) FILTER (mtime IS NULL) AS without_time, max(depth) AS deepest FROM files""")
add("watch_tier_report", lambda s, d: watch.report(_dirs(s, d), 400), f"""{_DIRS} SELECT count(*) FILTER (tier = 'L0') AS l0_dirs, count(*) FILTER (tier = 'L1') AS l1_dirs, count(*) FILTER (tier = 'L2') AS l2_dirs,
  count(*) FILTER (tier = 'L3') AS l3_dirs, count(*) FILTER (promotion_pending) AS pending_promotions, CAST(coalesce(sum(watch_cost) FILTER (tier = 'L0'), 0) AS BIGINT) AS watched_dirs,
  CAST(least(floor(coalesce(sum(watch_cost) FILTER (tier = 'L0'), 0) * 100 / 400), 100) AS BIGINT) AS budget_percent FROM dirs""")
add("watch_expired", lambda s, d: watch.expired(_dirs(s, d), 20_000, 7_200), f"{_DIRS} SELECT path FROM dirs WHERE tier = 'L0' AND NOT demotion_pending AND 20000 - last_event > 7200")
add("watch_next_scans", lambda s, d: watch.next_scans(_dirs(s, d), 10), f"{_DIRS} SELECT path FROM dirs WHERE tier = 'L1' AND NOT promotion_pending AND NOT demotion_pending ORDER BY last_scan, path LIMIT 10")
add("watch_admission", lambda s, d: watch.admission(_dirs(s, d).select("path", "watch_cost"), 300), f"""WITH RECURSIVE {_DIRS.lstrip().removeprefix("WITH ")},
o AS (SELECT path, watch_cost, row_number() OVER (ORDER BY path) AS k FROM dirs),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS path, CAST(0 AS BIGINT) AS watch_cost, CAST(0 AS BIGINT) AS used, false AS admitted
  UNION ALL SELECT o.k, o.path, o.watch_cost, walk.used + CASE WHEN walk.used + o.watch_cost <= 300 THEN o.watch_cost ELSE 0 END, walk.used + o.watch_cost <= 300 FROM walk JOIN o ON o.k = walk.k + 1)
SELECT path, watch_cost, admitted FROM walk WHERE k > 0""")
add("watch_cost", lambda s, d: watch.watch_cost(_dirs(s, d), "/corpus/src1", 20), f"{_DIRS} SELECT least(count(*), 20) AS watch_cost FROM dirs WHERE path = '/corpus/src1' OR starts_with(path, '/corpus/src1/')")
add("query_metrics", _metrics, f"""{EVENTS}, l AS (SELECT event_type = 'modify' AS q, size + 1 AS m FROM ev), t AS (SELECT count(*) FILTER (q) AS queries, CAST(sum(m) FILTER (q) AS BIGINT) AS query_micros,
  count(*) FILTER (NOT q) AS events, CAST(sum(m) FILTER (NOT q) AS BIGINT) AS event_micros FROM l)
SELECT *, query_micros // queries AS average_query_micros, event_micros // events AS average_event_micros FROM t""")
add("content_dedup", _content, "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE octet_length(encode(text)) <= 10485760 GROUP BY text")
add("layered_visibility", _layers, f"{NAMED} SELECT path, CASE WHEN size % 3 = 0 THEN -size ELSE size END AS size FROM files WHERE size % 3 <> 1")
add("longest_root", _under_roots, f"""{NAMED} SELECT path, CASE WHEN starts_with(path, '/corpus/src1/en/') THEN '/corpus/src1/en' WHEN starts_with(path, '/corpus/src1/') THEN '/corpus/src1' ELSE '/corpus' END AS root FROM files""")
add("excluded_components", _excluded, f"{NAMED} SELECT path, size FROM files WHERE NOT list_contains(segs, 'node_modules') AND NOT list_contains(segs, 'target')")




# What keeps a collection: counts, health, sizes, caps, repairs.


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    counters = _events(spark, sf_dir).groupBy(F.expr("ino % 40").alias("k")).agg(
        (F.max("size") % 3 != 1).alias("watch_enabled"), (n % 4 == 0).alias("watcher_degraded"), (n % 3).cast("int").alias("watch_failures"), (n % 100).cast("int").alias("budget_percent"), (n % 2).alias("last_snapshot")
    )
    return status.health(counters).select("k", F.size("issues").cast("long").alias("issues"), "index_health")


def _trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _events(spark, sf_dir).select(F.col("event_type").alias("process"), F.timestamp_seconds(F.col("seq") * 15).alias("ts"), "seq", F.col("size").cast("double").alias("value"))
    return status.trend(samples).select("process", "seq", "per_minute")


def _event_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(F.sum(events.estimated_bytes()).cast("long").alias("bytes"))


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events(spark, sf_dir)
    held = log.where("seq <= 300").select("path").distinct()
    return overlay.admit(held, log.where("seq > 300"), 700)[0].select("seq", "path")


def _bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.bounded(normalize(files(spark, sf_dir)).select(F.col("parent").alias("dir"), "path"), 7).select("path")


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = normalize(files(spark, sf_dir)).groupBy(F.col("parent").alias("path")).agg((F.min(F.unix_micros(F.col("mtime").cast("timestamp"))) * 1000).alias("mtime_ns"))
    return sync.changed_dirs(dirs, sync.DirtyScope(1704070810 * 10**9))


def _gap_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two directories' events come with a hole; they are read again as they are now."""
    now, log = normalize(files(spark, sf_dir)), _events(spark, sf_dir)
    base = now.where("size % 4 > 0").withColumn("size", F.col("size") + F.when(F.col("size") % 4 == 1, 100).otherwise(0))
    seen = log.where("seq <= 40 AND seq % 9 <> 4").withColumn("path", F.concat(F.lit("/corpus/src"), (F.col("seq") % 2 + 1).cast("string"), F.lit("/en/x")))
    read = lambda dirs: now if dirs is None else now.where(F.col("parent").isin(*dirs))
    return sync.verify_and_repair(base, seen, 1, read)[0].select("path", "size")


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = normalize(files(spark, sf_dir)).select("parent", "path", "size")
    added = now.where("size % 10 = 1").withColumn("path", F.concat("path", F.lit(".x")))
    return overlay.parents_applied(now, added, now.where("size % 7 = 2")).groupBy("parent").agg(F.count(F.lit(1)).alias("entries"))


add("file_count", lambda s, d: status.status(files(s, d)), f"{NAMED} SELECT count(*) AS indexed_count, false AS is_rebuilding FROM files")
add("health_report", _health, f"""{EVENTS}, c AS (SELECT ino % 40 AS k, max(size) % 3 <> 1 AS enabled, count(*) % 4 = 0 AS degraded, count(*) % 3 AS failures, count(*) % 100 AS percent, count(*) % 2 AS snap FROM ev GROUP BY ino % 40),
i AS (SELECT *, CASE WHEN NOT enabled THEN 1 WHEN degraded THEN 1 ELSE 0 END + CASE WHEN failures > 0 THEN 1 ELSE 0 END + CASE WHEN percent >= 90 THEN 1 ELSE 0 END + CASE WHEN snap = 0 THEN 1 ELSE 0 END AS n FROM c)
SELECT k, CAST(n AS BIGINT) AS issues, CASE WHEN NOT enabled THEN 'static' WHEN degraded THEN 'degraded' WHEN n = 0 THEN 'ok' ELSE 'warning' END AS index_health FROM i""")
add("trend_per_minute", _trend, f"""{EVENTS}, w AS (SELECT event_type AS process, seq, CAST(size AS DOUBLE) - first_value(CAST(size AS DOUBLE)) OVER x AS rise, (seq - first_value(seq) OVER x) * 15000000 / 60000000.0::DOUBLE AS minutes FROM ev
  WINDOW x AS (PARTITION BY event_type ORDER BY seq ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT process, seq, CASE WHEN minutes > 0 THEN rise / minutes ELSE 0.0 END AS per_minute FROM w""")
add("event_bytes", _event_bytes, f"{EVENTS} SELECT event_type, CAST(sum(strlen(path) + coalesce(strlen(from_path), 0)) AS BIGINT) AS bytes FROM ev GROUP BY event_type")
add("delta_cap", _capped, f"""{EVENTS}, held AS (SELECT DISTINCT path FROM ev WHERE seq <= 300), fresh AS (SELECT path, min(seq) AS seq FROM ev WHERE seq > 300 AND path NOT IN (SELECT path FROM held) GROUP BY path),
o AS (SELECT seq, row_number() OVER (ORDER BY seq) AS k FROM fresh), over AS (SELECT min(seq) AS seq FROM o WHERE k > 700 - (SELECT count(*) FROM held))
SELECT seq, path FROM ev WHERE seq > 300 AND seq < coalesce((SELECT seq FROM over), 9000000000)""")
add("bounded_scan", _bounded, f"{NAMED} SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY parent ORDER BY path) AS k FROM files) WHERE k <= 7")
add("changed_dirs", _changed, f"{NAMED} SELECT parent AS path FROM files GROUP BY parent HAVING min(mtime) > TIMESTAMP '2024-01-01 01:00:00'")
add("gap_repair", _gap_repair, f"""{NAMED} SELECT path, size + CASE WHEN size % 4 = 1 THEN 100 ELSE 0 END AS size FROM files WHERE size % 4 > 0 AND parent NOT IN ('/corpus/src1/en', '/corpus/src2/en')
  UNION ALL SELECT path, size FROM files WHERE parent IN ('/corpus/src1/en', '/corpus/src2/en')""")
add("parent_entries", _parents, f"""{NAMED}, now AS (SELECT parent, path FROM files UNION SELECT parent, path || '.x' FROM files WHERE size % 10 = 1)
SELECT parent, count(*) AS entries FROM now WHERE path NOT IN (SELECT path FROM files WHERE size % 7 = 2) GROUP BY parent""")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
