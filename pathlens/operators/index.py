"""An optional inverted index of three-byte pieces, and statistics of a file table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlens.functions.literals import longest_literal
from pathlens.functions.paths import normalize


def trigrams_of(segment: Column) -> Column:
    """The three-byte windows of a lower-case component, in hexadecimal."""
    data = F.hex(F.encode(F.lower(segment), "utf-8"))
    last = F.octet_length(F.lower(segment)) - 3
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(data, i * 2 + 1, F.lit(6)))).otherwise(F.array().cast("array<string>"))


def trigrams(files: DataFrame, key: str = "path") -> DataFrame:
    """(trigram, key) pairs of all path components, each once."""
    table = normalize(files)
    pieces = F.array_distinct(F.flatten(F.transform("segs", trigrams_of)))
    return table.select(key, F.explode(pieces).alias("trigram"))


def postings(files: DataFrame, key: str = "path") -> DataFrame:
    """How many rows have each trigram."""
    return trigrams(files, key).groupBy("trigram").agg(F.count(F.lit(1)).alias("n"))


def query_trigrams(pattern: str) -> list[str]:
    literal = (longest_literal(pattern) or "").lower().encode()
    return sorted({literal[i : i + 3].hex().upper() for i in range(len(literal) - 2)})


def candidates(index: DataFrame, pattern: str, key: str = "path") -> DataFrame | None:
    """Keys that have all trigrams of the pattern's longest literal, a superset of its matches; None if it has none.

    The trigrams are part of the filter, so only their row groups are read.
    """
    wanted = query_trigrams(pattern)
    if not wanted:
        return None
    return index.where(F.col("trigram").isin(*wanted)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select(key)


def candidates_any(index: DataFrame, patterns: list[str], key: str = "path") -> DataFrame | None:
    """Keys that one of the patterns may match, each once; None if one of them narrows nothing."""
    from functools import reduce

    found = [candidates(index, p, key) for p in patterns]
    return None if not found or any(f is None for f in found) else reduce(DataFrame.unionByName, found).distinct()


def narrowed(files: DataFrame, index: DataFrame, pattern: str, key: str = "path") -> DataFrame:
    """The rows worth testing for a pattern; the exact predicate still has to be applied."""
    found = candidates(index, pattern, key)
    return files if found is None else files.join(found, key, "left_semi")


def stats(files: DataFrame) -> DataFrame:
    """One row of counts and sizes: files, parents, bytes of paths and files, least and greatest time."""
    table = normalize(files)
    return table.agg(
        F.count(F.lit(1)).alias("file_count"), F.count_distinct("parent").alias("parents"), F.sum(F.octet_length("path")).cast("long").alias("path_bytes"),
        F.sum("size").cast("long").alias("total_size"), F.count_if(F.col("mtime").isNull()).alias("without_time"), F.max("depth").cast("long").alias("deepest"),
    )


def parent_counts(files: DataFrame) -> DataFrame:
    """Direct children per directory."""
    return normalize(files).groupBy("parent").agg(F.count(F.lit(1)).alias("children"))


def approximate_count(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Base rows plus live delta rows, counting a modified path twice; cheap, and only an upper bound."""
    return base.agg(F.count(F.lit(1)).alias("n")).unionByName(delta.where("live").agg(F.count(F.lit(1)).alias("n"))).agg(F.sum("n").alias("file_count"))
