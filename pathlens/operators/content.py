"""Content filters: repeats, size and binary data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 10 * 1024 * 1024
PROBE_BYTES = 8192


def is_binary(data: Column) -> Column:
    """Whether the first bytes hold a zero byte."""
    return F.contains(F.substring(data, 1, PROBE_BYTES), F.lit(b"\x00"))


def indexable(data: Column) -> Column:
    raw = data.cast("binary")
    return (F.octet_length(raw) <= MOST_BYTES) & ~is_binary(raw)


def dedup(files: DataFrame, content: str, order: str) -> DataFrame:
    """The first row (by ``order``) of each content that is worth indexing: its ``order`` value and copies."""
    kept = files.where(indexable(F.col(content)))
    return kept.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("digest")).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies")).drop("digest")
