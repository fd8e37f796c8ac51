"""Not-modified revisits of a crawl, resolved to the full responses they stand for.

A crawl record is (record_id, url, ts, kind, headers, digest): ``kind`` is
``response`` for a full response and ``revisit`` for a 304; ``headers`` maps
lower-case names to values; ``digest`` names the payload (null if not known).
For each revisit the latest response of the same canonical URL before it is
found, its validators are checked, and the stored headers are renewed with those
that a 304 may change.

The as-of join runs in two levels, so that an address with a great part of all
records does not meet in one task: records are cut into stretches of time of
about ``STRETCH`` records; within an address and stretch a running maximum finds
the latest response; across stretches only one row per address and stretch is
ordered. Payloads are never moved.

verdict      the latest earlier response ...
resolved     agrees in ETag (weakly), else in Last-Modified, else in digest
changed      has another value for the first of these that the revisit carries
unchecked    exists, but the two share no validator
missing      does not exist

Defined cases: null urls and times resolve to nothing (``missing``); null headers
count as none; of responses at the same time the greatest record_id is taken; a
response at the revisit's own time is not earlier; repeated revisits give
repeated rows, repeated responses count once; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathlens.operators.ordering import bucketed

STRETCH = 8_192
#: What a 304 may renew (fixed values, from RFC 9110 and RFC 9111).
RENEWABLE = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "via", "warning")
#: Query parameters that do not name a resource.
IDLE = r"^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)="


def canonical(url: Column) -> Column:
    """Host and path without scheme, user, ``www.``, default port, fragment, idle or unsorted
    parameters, and final slash; the host in lower case. Null for what has no host."""
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1)), r":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^/]*//[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(IDLE))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def parsed_headers(block: Column) -> Column:
    """The map of a raw header block; names in lower case, the last of equal names wins."""
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def weak(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def latest_before(records: DataFrame) -> DataFrame:
    """Revisits with ``found``, struct(ts, record_id) of the latest earlier response of their page."""
    staged = records.withColumn("__time", F.unix_micros(F.col("ts").cast("timestamp")))
    stretch = "__bucket"
    cut = bucketed(staged, F.col("__time"), STRETCH)
    response = F.when((F.col("kind") == "response") & F.col("__time").isNotNull(), F.struct(F.col("__time").alias("ts"), "record_id"))
    cut = cut.withColumn("__response", response)
    inside = Window.partitionBy("page", stretch).orderBy("__time").rangeBetween(Window.unboundedPreceding, -1)
    placed = cut.where("page IS NOT NULL").withColumn("__near", F.max("__response").over(inside)).where("kind = 'revisit'")
    ends = cut.where("page IS NOT NULL").groupBy("page", stretch).agg(F.max("__response").alias("__end"))
    earlier = Window.partitionBy("page").orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("page").alias("__page"), F.col(stretch).alias("__at"), F.max("__end").over(earlier).alias("__far"))
    joined = placed.join(ends, (F.col("page") == F.col("__page")) & (F.col(stretch) == F.col("__at")))
    known = joined.withColumn("found", F.when(F.col("__time").isNotNull(), F.coalesce("__near", "__far")))
    unplaced = cut.where("page IS NULL AND kind = 'revisit'").withColumn("found", F.lit(None).cast("struct<ts:bigint,record_id:bigint>"))
    columns = [*records.columns, "found"]
    return known.select(*columns).unionByName(unplaced.select(*columns))


def resolve(records: DataFrame) -> DataFrame:
    """Per revisit: record_id, page (canonical URL), ts, response_id, verdict, headers (merged if resolved)."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    known = records.select(F.col("record_id").cast("long"), canonical(F.col("url")).alias("page"), "ts", "kind", F.coalesce(F.col("headers"), none).alias("headers"), "digest")
    visits = latest_before(known)
    stored = known.where("kind = 'response'").select(F.col("record_id").alias("response_id"), F.col("page").alias("__page"), F.unix_micros(F.col("ts").cast("timestamp")).alias("__ts"), F.col("headers").alias("stored"), F.col("digest").alias("stored_digest"))
    stored = stored.dropDuplicates(["response_id", "__page", "__ts"])
    pairs = visits.join(stored, (F.col("found.record_id") == F.col("response_id")) & (F.col("page") == F.col("__page")) & (F.col("found.ts") == F.col("__ts")), "left")

    def agrees(new: Column, old: Column) -> Column:
        return F.when(new.isNotNull() & old.isNotNull(), new == old)

    same = F.coalesce(agrees(weak(F.col("headers")["etag"]), weak(F.col("stored")["etag"])), agrees(F.col("headers")["last-modified"], F.col("stored")["last-modified"]), agrees(F.col("digest"), F.col("stored_digest")))
    verdict = F.when(F.col("response_id").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("changed")
    renewed = F.map_filter("headers", lambda k, v: k.isin(*RENEWABLE))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.map_contains_key(renewed, k)), renewed)
    judged = pairs.withColumn("verdict", verdict)
    return judged.select("record_id", "page", "ts", "response_id", "verdict", F.when(F.col("verdict") == "resolved", merged).alias("headers"))


def with_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """Resolved revisits with the ``payload`` of their response, of (record_id, payload)."""
    ready = resolved.where("verdict = 'resolved'")
    return ready.join(payloads.select(F.col("record_id").alias("response_id"), "payload"), "response_id")


def read_warc(spark: SparkSession, *paths: str) -> DataFrame:
    """Crawl records of WARC files (plain or gzip, any file system that Spark reads): record_id (a
    hash of the record's own), url, ts, kind, headers, digest, refers_to, whole.

    Records are told apart by their version line, so a large plain file is read
    by many tasks, and payloads are not kept. ``kind`` is ``response``,
    ``revisit`` or the record's type; ``headers`` are those of the HTTP message.
    ``whole`` says that the block has the bytes that the record promises (it may
    seem not to, where a payload is not in UTF-8).
    """
    raw = spark.read.option("lineSep", "WARC/1.").text(list(paths)).where(F.col("value").rlike(r"^[01]\r?\n"))
    own = F.regexp_extract("value", r"(?s)^[01]\r?\n(.*?)\r?\n\r?\n", 1)
    block = F.regexp_replace("value", r"(?s)^[01]\r?\n.*?\r?\n\r?\n", "")
    head = F.regexp_extract(block, r"(?s)^HTTP/[^\n]*\n(.*?)(?:\r?\n\r?\n|\z)", 1)
    named = raw.select(parsed_headers(own).alias("own"), F.octet_length(block).alias("bytes"), parsed_headers(head).alias("headers"))
    field = lambda name: F.col("own")[name]
    number = lambda name: F.when(field(name).isNotNull(), F.xxhash64(field(name)))
    return named.select(
        number("warc-record-id").alias("record_id"), field("warc-target-uri").alias("url"), F.to_timestamp(field("warc-date")).alias("ts"), F.lower(field("warc-type")).alias("kind"),
        "headers", field("warc-payload-digest").alias("digest"), number("warc-refers-to").alias("refers_to"), (F.col("bytes") >= field("content-length").try_cast("long")).alias("whole"),
    )


def crawl(pages: DataFrame) -> DataFrame:
    """A crawl made of ``pages``, four records for each.

    Page i is fetched at second 10 i, and asked for again 25 seconds later (5
    seconds before, for every third page) under another spelling of its address.
    The front page of its host, which many pages share, is fetched at second 40
    (i div 4), so that responses of one address and one time occur, and asked for
    again up to 20 seconds before or 10 after. It changes with every 32nd page.
    An answer "not modified" carries the ETag, for every fifth page another one,
    and for every seventh no ETag but the same or a later Last-Modified.
    """
    i, tag = F.col("page_id"), F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), F.lit('"'))
    front = F.concat(F.lit("http://"), F.regexp_extract(F.trim("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("/"))
    version = F.expr("page_id div 32")
    version_tag = F.concat(F.lit('"v'), version.cast("string"), F.lit('"'))
    front_time = F.expr("page_id div 4") * 40
    day = lambda n: F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int")), "yyyy-MM-dd")

    def response(k: int, url: Column, second: Column, etag: Column, changed: Column, size: Column, digest: Column) -> Column:
        headers = F.create_map(F.lit("etag"), etag, F.lit("last-modified"), changed, F.lit("content-length"), size.cast("string"), F.lit("date"), second.cast("string"), F.lit("server"), F.lit("one"))
        return F.struct((i * 4 + k).alias("record_id"), url.alias("url"), F.timestamp_seconds(second).alias("ts"), F.lit("response").alias("kind"), headers.alias("headers"), digest.alias("digest"))

    def revisit(k: int, url: Column, second: Column, etag: Column, changed: Column) -> Column:
        shared = F.create_map(F.lit("last-modified"), changed, F.lit("content-length"), F.lit("0"), F.lit("date"), second.cast("string"), F.lit("cache-control"), F.concat(F.lit("max-age="), (i % 100).cast("string")), F.lit("server"), F.lit("two"))
        own = F.when(i % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), etag))
        headers = F.when(i % 7 == 0, shared).otherwise(F.map_concat(shared, F.create_map(F.lit("etag"), own)))
        return F.struct((i * 4 + k).alias("record_id"), url.alias("url"), F.timestamp_seconds(second).alias("ts"), F.lit("revisit").alias("kind"), headers.alias("headers"), F.lit(None).cast("string").alias("digest"))

    records = F.array(
        response(0, F.col("url"), i * 10, tag, day(i % 1000), F.octet_length(F.coalesce("html", F.lit(""))), tag),
        revisit(1, F.concat(F.col("url"), F.lit("#again")), F.when(i % 3 == 0, i * 10 - 5).otherwise(i * 10 + 25), tag, day(i % 1000 + (i % 2))),
        response(2, front, front_time, version_tag, day(version % 1000), i % 7 + 100, version_tag),
        revisit(3, front, front_time + (i % 4) * 10 - 20, version_tag, day(version % 1000)),
    )
    return pages.where(i.isNotNull()).select(F.inline(records))


def report(pages: DataFrame) -> DataFrame:
    """The resolved revisits of ``crawl(pages)``."""
    done = resolve(crawl(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return done.select("record_id", F.expr("record_id div 4").alias("page_id"), F.col("page").alias("canonical_url"), "response_id", "verdict", lines.alias("headers"))


ORACLE = r"""
WITH p AS (
  SELECT page_id AS i, '"' || md5(coalesce(html, '')) || '"' AS tag, octet_length(encode(coalesce(html, ''))) AS n, url,
    'http://' || regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1) || '/' AS front,
    '"v' || (page_id // 32) || '"' AS vtag, 40 * (page_id // 4) AS ft, page_id // 32 AS v FROM pages WHERE page_id IS NOT NULL),
resp AS (
  SELECT i * 4 AS rid, url, i * 10 AS t, tag AS etag, i % 1000 AS d, n FROM p
  UNION ALL SELECT i * 4 + 2, front, ft, vtag, v % 1000, i % 7 + 100 FROM p),
rev AS (
  SELECT i * 4 + 1 AS rid, i, url, CASE WHEN i % 3 = 0 THEN i * 10 - 5 ELSE i * 10 + 25 END AS t, tag AS etag, i % 1000 + i % 2 AS d FROM p
  UNION ALL SELECT i * 4 + 3, i, front, ft + 10 * (i % 4) - 20, vtag, v % 1000 FROM p),
u AS (
  SELECT DISTINCT url, regexp_replace(trim(url), '#.*$', '') AS u FROM (SELECT url FROM p UNION ALL SELECT front FROM p)),
h AS (
  SELECT url, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)), ':(?:80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(u, '^[^/]*//[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)='))), '&') AS q FROM u),
c AS (
  SELECT url, CASE WHEN host <> '' THEN host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS page FROM h),
r AS (
  SELECT resp.*, c.page FROM resp LEFT JOIN c USING (url)),
w AS (
  SELECT rev.rid, rev.i, rev.t, rev.d, c.page, CASE WHEN i % 7 = 0 THEN NULL WHEN i % 5 = 0 THEN '"other"' ELSE 'W/' || etag END AS etag FROM rev LEFT JOIN c USING (url)),
m AS (
  SELECT w.rid, max(r.t * 1000000000000::HUGEINT + r.rid) AS f FROM w LEFT JOIN r ON r.page = w.page AND r.t < w.t GROUP BY w.rid),
j AS (
  SELECT w.*, r.rid AS r_id, r.etag AS r_etag, r.n AS r_n,
    CASE WHEN r.rid IS NULL THEN 'missing'
      WHEN w.etag IS NOT NULL THEN CASE WHEN replace(w.etag, 'W/', '') = r.etag THEN 'resolved' ELSE 'changed' END
      WHEN w.d = r.d THEN 'resolved' ELSE 'changed' END AS verdict
  FROM w JOIN m USING (rid) LEFT JOIN r ON r.rid = m.f % 1000000000000)
SELECT CAST(rid AS BIGINT) AS record_id, CAST(i AS BIGINT) AS page_id, page AS canonical_url, CAST(r_id AS BIGINT) AS response_id, verdict,
  CASE WHEN verdict = 'resolved' THEN 'cache-control: max-age=' || (i % 100) || chr(10) || 'content-length: ' || r_n || chr(10) || 'date: ' || t
    || chr(10) || 'etag: ' || coalesce(etag, r_etag) || chr(10) || 'last-modified: ' || strftime(DATE '2020-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') || chr(10) || 'server: one' END AS headers
FROM j
"""
