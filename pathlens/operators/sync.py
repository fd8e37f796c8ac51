"""Comparing a scan with an index, and bringing the index up to date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathlens.functions.paths import normalize

from . import events as ev
from .overlay import KEY

IMMEDIATE_DIRS, IMMEDIATE_ENTRIES = 10, 10_000
DEEP_ENTRIES = 50_000
MARGIN_NS = 10 * 10**9


@dataclass(frozen=True)
class DirtyScope:
    """What to check again: all directories changed since a time, or the given ones."""

    cutoff_ns: int = 0
    dirs: tuple[str, ...] | None = None


def changed_dirs(dirs: DataFrame, scope: DirtyScope) -> DataFrame:
    """Paths of (path, mtime_ns) directories in scope, in order; a cutoff of 0 means all."""
    if scope.dirs is not None:
        rows = dirs.where(F.col("path").isin(*scope.dirs))
    elif scope.cutoff_ns:
        rows = dirs.where(F.col("mtime_ns") > scope.cutoff_ns - MARGIN_NS)
    else:
        rows = dirs
    return rows.select("path").distinct().orderBy("path")


def freshness(scan: DataFrame, index: DataFrame) -> DataFrame:
    """(path, state) of each scanned file: ``unchanged``, ``changed`` or ``missing`` from the index.

    Looked up by path; failing that, by identity with the same path. Size and
    time must agree, unknown times with unknown ones.
    """
    known = index.select("path", F.col("size").alias("__size"), F.col("mtime").alias("__mtime"), F.lit(True).alias("__there"))
    joined = scan.join(known, "path", "left")
    same = F.col("size").eqNullSafe(F.col("__size")) & F.col("mtime").eqNullSafe(F.col("__mtime"))
    return joined.select("path", F.when(F.col("__there").isNull(), "missing").when(same, "unchanged").otherwise("changed").alias("state"))


def repair_needed(states: DataFrame, mode: str = "dirty-only", most_ratio: float = 0.3) -> DataFrame:
    """scanned, changed, changed_ratio, escalate: whether a scan found too much to repair piece by piece."""
    counts = states.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("state") != "unchanged").alias("changed"))
    ratio = F.coalesce(F.try_divide("changed", "scanned"), F.lit(0.0)).cast("double")
    decided = {"never": F.lit(False), "always": F.lit(True)}.get(mode, (F.col("scanned") == 0) | (F.col("changed_ratio") > most_ratio))
    return counts.withColumn("changed_ratio", ratio).withColumn("escalate", decided)


def delete_alignment(base: DataFrame, dirty: DataFrame, current: DataFrame) -> DataFrame:
    """Indexed files directly in dirty directories that are no longer there."""
    table = normalize(base)
    children = table.join(dirty.select(F.col("path").alias("parent")), "parent", "left_semi")
    return children.join(current.select("path"), "path", "left_anti").select("path")


def fast_sync(base: DataFrame, dirty: DataFrame, current: DataFrame) -> DataFrame:
    """The index after dirty directories were read again as ``current``."""
    gone = delete_alignment(base, dirty, current)
    rest = base.join(gone.unionByName(current.select("path")), "path", "left_anti").join(current.select(*KEY), list(KEY), "left_anti")
    return rest.unionByName(current.select(*base.columns))


def incremental_scan(base: DataFrame, dirs: DataFrame, scope: DirtyScope, read_dirs) -> DataFrame:
    """The index after the directories (path, mtime_ns) in scope were read again with ``read_dirs(paths)``."""
    dirty = changed_dirs(dirs, scope)
    return fast_sync(base, dirty, read_dirs([r.path for r in dirty.collect()]))


def verify_and_repair(base: DataFrame, events: DataFrame, verified: int, read_dirs) -> tuple[DataFrame, dict]:
    """The index after a check of the event numbers, and a report.

    If a number is missing after ``verified``, the directories of the events (all,
    if there are too many) are read again with ``read_dirs(dirs or None)``.
    """
    gap = ev.first_gap(events, verified).first()
    top = events.agg(F.max("seq")).first()[0] or verified
    report = {"verified": max(top, verified), "gap": gap and gap.asDict()}
    if gap is None:
        return base, report
    dirs = ev.repair_scope(events)
    current = read_dirs(dirs)
    if dirs is None:
        return current.select(*base.columns), report
    dirty = base.sparkSession.createDataFrame([(d,) for d in dirs], "path string")
    return fast_sync(base, dirty, current), report


def bounded(entries: DataFrame, most: int = IMMEDIATE_ENTRIES) -> DataFrame:
    """At most ``most`` entries of each scanned directory (``dir``), by path."""
    order = Window.partitionBy("dir").orderBy("path")
    return entries.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")
