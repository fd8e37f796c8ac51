"""Change events: states per path, coalescing, rename pairing, gaps, log clean-up.

Events: seq, ts, event_type (create, delete, modify, rename), path, from_path,
and the stat payload of ``path`` at that time (dev, ino, generation, size,
mtime); a null payload says that the file was gone. The order is that of
``seq``, which is given on arrival; event time plays no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered, with_previous_max

PAIR_SECONDS = 10
KINDS = ("create", "delete", "modify", "rename")


def best_path() -> Column:
    return F.coalesce("path_hint", "path")


def typed(events: DataFrame) -> DataFrame:
    """Unknown event types count as modifications."""
    return events.withColumn("event_type", F.when(F.lower("event_type").isin(*KINDS), F.lower("event_type")).otherwise("modify"))


def states(events: DataFrame) -> DataFrame:
    """One row per path that an event touches: a rename deletes its source and leaves its target live."""
    payload = [c for c in events.columns if c not in ("path", "from_path")]
    own = events.select(*payload, "path", (F.col("event_type") != "delete").alias("live"), F.lit(False).alias("left"))
    gone = events.where("event_type = 'rename' AND from_path IS NOT NULL").select(*payload, F.col("from_path").alias("path"), F.lit(False).alias("live"), F.lit(True).alias("left"))
    return own.unionByName(gone).where("path IS NOT NULL")


def latest(rows: DataFrame, keys: list[str], by: str = "seq") -> DataFrame:
    """The last row per key; combined on the map side, so a busy key does no harm."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(by)).alias("__last")).select(*keys, *(F.col(f"__last.{c}").alias(c) for c in rest))


def delta(events: DataFrame) -> DataFrame:
    """The latest state of each path."""
    return latest(states(events), ["path"]).drop("left")


def coalesce(events: DataFrame) -> DataFrame:
    """The events of a batch that count: the last of each path, none for a path that was renamed away after."""
    return latest(states(events).select("path", "seq", "left"), ["path"]).where("NOT left").select("path", "seq").join(events, ["path", "seq"])


def pair_renames(raw: DataFrame, seconds: int = PAIR_SECONDS, expire_as_delete: bool = False) -> DataFrame:
    """Halves of renames (``rename_from``, ``rename_to`` with a cookie) joined to whole ones.

    A target pairs with the event of its cookie before it, if that is a source
    less than ``seconds`` old. An unpaired target is a modification. An unpaired
    source is dropped, or becomes a deletion if asked for.
    """
    order = Window.partitionBy("cookie").orderBy("seq")
    half = F.col("event_type").isin("rename_from", "rename_to") & F.col("cookie").isNotNull()
    halves = raw.where(half).withColumn("__kind", F.lag("event_type").over(order)).withColumn("__path", F.lag("path").over(order)).withColumn("__ts", F.lag("ts").over(order))
    near = F.col("ts") < F.col("__ts") + F.expr(f"INTERVAL {seconds} SECONDS")
    pairs = (F.col("event_type") == "rename_to") & (F.col("__kind") == "rename_from") & near
    paired = F.coalesce(pairs, F.lit(False))
    halves = halves.withColumn("from_path", F.when(paired, F.col("__path"))).withColumn("__used", F.coalesce(F.lead(paired).over(order), F.lit(False)))
    targets = halves.where("event_type = 'rename_to'").withColumn("event_type", F.when(F.col("from_path").isNull(), "modify").otherwise("rename"))
    columns = [*(c for c in raw.columns if c != "from_path"), "from_path"]
    plain = (raw if "from_path" in raw.columns else raw.withColumn("from_path", F.lit(None).cast("string"))).where(~F.coalesce(half, F.lit(False)))
    out = plain.withColumn("event_type", F.when(F.col("event_type").isin("rename_from", "rename_to"), "modify").otherwise(F.col("event_type"))).select(*columns).unionByName(targets.select(*columns))
    if expire_as_delete:
        lost = halves.where("event_type = 'rename_from' AND NOT __used").withColumn("event_type", F.lit("delete")).withColumn("from_path", F.lit(None).cast("string"))
        out = out.unionByName(lost.select(*columns))
    return out


def clean_log(records: DataFrame, position: str = "pos") -> DataFrame:
    """Log records without repeats of (path, ts), the last of each kept, with ``seq`` numbered anew from 1."""
    kept = latest(records.drop("seq"), ["path", "ts"], position)
    return numbered(kept, position, "seq").drop(position)


def gaps(events: DataFrame, verified: int = 0) -> DataFrame:
    """Every jump in ``seq`` beyond ``verified``: expected, observed, missing."""
    seen = with_previous_max(events.where(F.col("seq") > verified).select("seq").distinct(), "seq", "__last")
    seen = seen.withColumn("__last", F.coalesce("__last", F.lit(verified if verified > 0 else None).cast("long")))
    return seen.where("seq > __last + 1").select((F.col("__last") + 1).alias("expected_seq"), F.col("seq").alias("observed_seq"), (F.col("seq") - F.col("__last") - 1).alias("missing_count"))


def first_gap(events: DataFrame, verified: int = 0) -> DataFrame:
    return gaps(events, verified).orderBy("observed_seq").limit(1)


def repair_scope(events: DataFrame, most: int = 16) -> list[str] | None:
    """The parents of the events' paths; None, for all, if there are more than ``most``."""
    from pathlens.functions.paths import parent_of

    rows = events.select(parent_of(F.col("path")).alias("d")).distinct().orderBy("d").limit(most + 1).collect()
    return None if len(rows) > most or any(r.d is None for r in rows) else [r.d for r in rows]


def estimated_bytes() -> Column:
    """Memory that an event holds: its paths and hints; 16 for an identity without a path."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    return F.when(F.col("path").isNull(), 16).otherwise(size("path")) + size("from_path")
