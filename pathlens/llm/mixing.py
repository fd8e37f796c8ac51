"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source, targets follow from weights, and a document is
emitted ``floor(rate)`` times plus once more when a hash of its id falls below
the rate's fraction. The per-source table has one row per source and joins by
key, so Spark may broadcast it only where its real size allows.

Defined cases: a null text has size 0 and its copies follow the same draw; a
null source is a source of its own and the last in order; rows that repeat a
doc_id share one draw; documents with a null doc_id draw by their text, so that
only equal ones share a draw; an empty table gives an empty result; other columns
pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import SPACE_RUNS, quoted, unused

#: Weights by the rank of a source, repeated.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_RUNS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Per source of (source, size): source_size, target, rate.

    A source's target is its weight times a common level, or ``most`` times its
    size if that is less. Sources in order of size over weight reach that limit
    first, so the level follows from sums over this order. The order runs over
    sources, not documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = per.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * F.lit(most))
    by_need = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before, onward, everything = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    capped = F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * F.lit(share) - capped) / F.sum("__w").over(onward)
    leveled = ranked.withColumn("__level", level)
    # the first source that the level does not lift to its limit sets the level for all after it
    free = F.min(F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct(F.col("__cap") / F.col("__w"), F.col("source").isNull(), F.col("source"), F.col("__level")))).over(everything)
    settled = leveled.withColumn("__free", free["__level"])
    target = F.coalesce(F.least(F.col("__cap"), F.col("__w") * F.col("__free")), F.col("__cap"))
    done = settled.withColumn("target", target)
    return done.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)).alias("rate"))


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a hash of seed and key."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return bits.cast("double") / F.lit(float(2**52))


def with_copies(documents: DataFrame, seed: str = "mix-1", **shape) -> tuple[DataFrame, list[str]]:
    """``documents`` with four more columns, and their names, which no other column has: size,
    source_size, target, copies."""
    size, source_size, target, copies, source, rate = unused(documents, "size", "source_size", "target", "copies", "mix_source", "mix_rate")
    sized = documents.withColumn(size, word_count(F.col("text")))
    targets = source_targets(sized.select("source", F.col(quoted(size)).alias("size")), **shape).toDF(source, source_size, target, rate)
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col(quoted(source))))
    # documents without an id draw by their text
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    share = F.col(quoted(rate))
    counted = joined.withColumn(copies, F.floor(share) + (draw(key, seed) < share - F.floor(share)).cast("long"))
    added = [size, source_size, target, copies]
    return counted.select(*(F.col(quoted(c)) for c in (*documents.columns, *added))), added


def mix(documents: DataFrame, seed: str = "mix-1", **shape) -> DataFrame:
    """The mixed corpus: every document as often as its draw says, columns as given."""
    counted, (*_, copies) = with_copies(documents, seed, **shape)
    (number,) = unused(counted, "mix_copy")
    many = counted.where(F.col(quoted(copies)) > 0).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col(quoted(copies)))).alias(number))
    return many.select(*(F.col(quoted(c)) for c in documents.columns))


def report(documents: DataFrame, seed: str = "mix-1", **shape) -> DataFrame:
    """Per document: what the mix takes of it, in words."""
    counted, _ = with_copies(documents.select("doc_id", "text", "source"), seed, **shape)
    return counted.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
    [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1] AS w FROM s),
fill AS (
  SELECT 0 AS step, (SELECT sum(source_size) * 1.5::DOUBLE / sum(w) FROM w) AS lv,
    (SELECT count(*) FROM w) AS open_n
  UNION ALL
  SELECT step + 1,
    (SELECT (sum(source_size) * 1.5::DOUBLE - coalesce(sum(cap) FILTER (cap < w * lv), 0.0)) / sum(w) FILTER (cap >= w * lv) FROM w),
    (SELECT count(*) FROM w WHERE cap >= w * lv)
  FROM fill WHERE step < 200 AND EXISTS (SELECT 1 FROM w WHERE cap >= w * lv)
    AND (SELECT count(*) FROM w WHERE cap >= w * lv) < open_n),
last AS (SELECT arg_max(lv, step) AS lv FROM fill WHERE lv IS NOT NULL),
t AS (
  SELECT source, source_size, least(cap, coalesce(w * (SELECT lv FROM last), cap)) AS target FROM w),
r AS (
  SELECT d.doc_id, d.digest, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(2.0, t.target / t.source_size) ELSE 0.0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN
    CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), digest)), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate)
    THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
