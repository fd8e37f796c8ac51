"""Status, metrics and health as one-row DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def status(files: DataFrame, rebuilding: bool = False) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("indexed_count")).withColumn("is_rebuilding", F.lit(rebuilding))


def metrics(log: DataFrame) -> DataFrame:
    """Totals over (kind, micros): counts of queries and events, and whole average microseconds (0 if none)."""
    n = lambda k: F.count_if(F.col("kind") == k)
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("micros"))), F.lit(0)).cast("long")
    sums = log.agg(n("query").alias("queries"), total("query").alias("query_micros"), n("event").alias("events"), total("event").alias("event_micros"))
    average = lambda k: F.when(F.col(f"{k[0]}") > 0, F.expr(f"{k[1]} div {k[0]}")).otherwise(F.lit(0).cast("long"))
    return sums.withColumn("average_query_micros", average(("queries", "query_micros"))).withColumn("average_event_micros", average(("events", "event_micros")))


#: Counters of a health record and their values where they are not given.
COUNTERS = {
    "watch_enabled": True, "watcher_degraded": False, "degraded_roots": 0, "watch_failures": 0, "overflow_drops": 0, "rescan_signals": 0, "promotion_blocked": 0,
    "budget_percent": 0, "truncated_records": 0, "repair_escalated": False, "last_snapshot": 0,
}


def health(counters: DataFrame) -> DataFrame:
    """``counters`` with ``issues`` and ``index_health`` (ok, warning, degraded, static)."""
    df = counters.withColumns({k: F.lit(v) for k, v in COUNTERS.items() if k not in counters.columns})
    c = F.col
    said = lambda form, *cols: F.format_string(form, *cols)
    issues = F.array(
        F.when(~c("watch_enabled"), "watcher_disabled").when(c("watcher_degraded"), said("watcher_degraded: %d unwatched directories are using fallback polling", c("degraded_roots"))),
        F.when(c("watch_failures") > 0, said("watch_failures: %d", c("watch_failures"))),
        F.when((c("overflow_drops") > 0) | (c("rescan_signals") > 0), said("event_recovery: overflow_drops=%d rescan_signals=%d", c("overflow_drops"), c("rescan_signals"))),
        F.when(c("promotion_blocked") > 0, said("watch_budget: %d promotion attempt(s) blocked", c("promotion_blocked"))),
        F.when(c("budget_percent") >= 90, said("watch_budget: utilization=%d%%", c("budget_percent"))),
        F.when(c("truncated_records") > 0, said("wal_recovery: truncated_tail_records=%d", c("truncated_records"))),
        F.when(c("repair_escalated"), "startup_repair: escalated to rebuild policy"),
        F.when(c("last_snapshot") == 0, "snapshot_not_written_yet"),
    )
    state = F.when(~c("watch_enabled"), "static").when(c("watcher_degraded"), "degraded").when(F.size("issues") == 0, "ok").otherwise("warning")
    return df.withColumn("issues", F.filter(issues, lambda x: x.isNotNull())).withColumn("index_health", state)


def trend(samples: DataFrame, per: str = "process", width: int = 12) -> DataFrame:
    """``per_minute``: change of ``value`` over the last ``width`` samples, by minutes of ``ts``."""
    w = Window.partitionBy(per).orderBy("ts").rowsBetween(1 - width, 0)
    minutes = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.first("ts").over(w).cast("timestamp"))) / 60_000_000.0
    return samples.withColumn("per_minute", F.when(minutes > 0, (F.col("value") - F.first("value").over(w)) / minutes).otherwise(0.0))


def heap_high_water(index_bytes: int, dirty_bytes: int) -> bool:
    """Whether memory outside the index is worth giving back: 32 MiB at least, and twice the index fits in it."""
    return dirty_bytes >= 32 * 1024 * 1024 and 2 * index_bytes <= dirty_bytes
