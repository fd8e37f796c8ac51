"""Positions and predecessors in a total order, without one task that sorts everything.

Rows are cut into buckets of neighbouring keys of about equal numbers of rows,
whatever the keys' distribution: the cuts are quantiles of a sample of keys.
Windows run inside a bucket, and only one row per bucket is ordered globally.

The sample holds about ``PER_BUCKET`` keys a bucket, and there are at most
``MOST_BUCKETS`` buckets, so at most some hundred thousand short strings reach
the driver; the cuts are a constant of the plan. A row is sampled by a hash of
its key, so reruns cut alike. Cuts decide where rows are sorted, not how: every
row is in exactly one bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 50_000
PER_BUCKET = 16
MOST_BUCKETS = 16_384
_SIGN = -(2**63)


def sort_key(key: Column, tie: Column | None = None) -> Column:
    """A string in whose order whole-number keys rise, nulls first, ties by a further whole number."""
    rising = lambda c: F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(_SIGN))), 16, "0")
    first = F.when(key.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), rising(key)))
    return first if tie is None else F.concat(first, rising(tie))


def bucketed(df: DataFrame, key: Column, rows: int = BUCKET_ROWS, tie: Column | None = None, name: str = "__bucket") -> DataFrame:
    """``df`` with ``name``, a number that rises with (``key``, ``tie``); rows of equal (key, tie) share it."""
    n = df.count()
    wanted = max(1, min(MOST_BUCKETS, n // rows))
    at = sort_key(key, tie)
    cuts: list[str] = []
    if wanted > 1:
        share = min(1.0, PER_BUCKET * wanted / n)
        keys = df.select(at.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30)))
        sample = sorted(r.k for r in keys.collect())
        cuts = sorted({sample[i * len(sample) // wanted] for i in range(1, wanted)}) if sample else []
    if not cuts:
        return df.withColumn(name, F.lit(0).cast("long"))
    # one constant each: the cuts, and every so manieth of them
    width = math.isqrt(len(cuts)) + 1
    listed = lambda keys: F.split(F.lit(",".join(keys)), ",")
    below = lambda keys, k: F.size(F.filter(keys, lambda c: c <= k))
    held = F.transform(F.array(at), lambda k: _place(listed(cuts), listed(cuts[::width]), width, k, below))
    return df.withColumn(name, F.element_at(held, 1).cast("long"))


def _place(cuts: Column, coarse: Column, width: int, key: Column, below) -> Column:
    """How many cuts are not above ``key``: whole stretches of ``width`` first, then within the last one."""
    block = F.greatest(below(coarse, key) - 1, F.lit(0))
    return block * width + below(F.slice(cuts, block * width + 1, F.lit(width)), key)


def running_totals(df: DataFrame, key: Column, tie: Column, values: dict[str, Column], rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds, for each name in ``values``, the sum of its column over all rows before this one, by ``key`` (nulls first) and ``tie``."""
    cut = bucketed(df, key, rows, tie).withColumn("__key", key).withColumn("__tie", tie).withColumns({f"__v{i}": v for i, v in enumerate(values.values())})
    totals = cut.groupBy("__bucket").agg(*(F.sum(f"__v{i}").alias(f"__t{i}") for i in range(len(values))))
    line = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__bucket", *(F.coalesce(F.sum(f"__t{i}").over(line), F.lit(0)).alias(f"__b{i}") for i in range(len(values))))
    inside = Window.partitionBy("__bucket").orderBy(F.col("__key").asc_nulls_first(), "__tie").rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumns({f"__v{i}": F.coalesce(F.sum(f"__v{i}").over(inside), F.lit(0)) for i in range(len(values))}).join(before, "__bucket")
    return summed.select(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns), *((F.col(f"__b{i}") + F.col(f"__v{i}")).alias(name) for i, name in enumerate(values)))


def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """Adds ``out``: 1, 2, ... in the order of ``key``, nulls first and ties in the order of a hash of all columns."""
    counted = running_totals(df, F.col(key), F.xxhash64(*df.columns), {out: F.lit(1)})
    return counted.withColumn(out, F.col(out) + 1)


def with_previous_max(df: DataFrame, key: str, out: str) -> DataFrame:
    """Adds ``out``: the greatest ``key`` below the row's own; null if there is none, or no own."""
    cut = bucketed(df, F.col(key))
    line = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("__bucket").agg(F.max(key).alias("__max")).select("__bucket", F.max("__max").over(line).alias("__before"))
    inside = Window.partitionBy("__bucket").orderBy(key).rangeBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col(key).isNotNull(), F.coalesce("__near", "__before"))
    return cut.withColumn("__near", F.max(key).over(inside)).join(before, "__bucket").withColumn(out, known).drop("__bucket", "__near", "__before")
