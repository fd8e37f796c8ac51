"""A delta of changes laid over a base table of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .events import delta as delta_of
from .events import latest

KEY = ("dev", "ino", "generation")
#: Paths that a delta may hold before it has to be merged.
MOST_PATHS = 262_144


def with_key(df: DataFrame) -> DataFrame:
    """Adds the identity columns that ``df`` lacks (device 1, generation 0)."""
    return df.withColumns({c: F.lit(v).cast(t) for c, v, t in (("dev", 1, "long"), ("generation", 0, "int")) if c not in df.columns})


def visible_files(base: DataFrame, delta: DataFrame) -> DataFrame:
    """The files that are there: base rows that the delta leaves alone, and live delta rows.

    A delta row hides the base row of its path and, if live, that of its
    identity, before any predicate is applied. A live row without payload is no
    file and hides nothing. Both anti-joins are on plain columns, so the planner
    broadcasts the delta while its size allows.
    """
    delta = with_key(delta)
    known = delta.where("NOT live OR size IS NOT NULL")
    live = latest(known.where("live"), list(KEY))
    rest = base.join(known.select("path"), "path", "left_anti").join(live.select(*KEY), list(KEY), "left_anti")
    columns = [c for c in base.columns if c in live.columns]
    return rest.select(*columns).unionByName(live.select(*columns))


def apply_events(files: DataFrame, events: DataFrame) -> DataFrame:
    """The file table after all ``events``."""
    return visible_files(files, delta_of(events))


def layered(layers: list[tuple[DataFrame, DataFrame | None]]) -> DataFrame:
    """Ordered (rows, deleted paths) layers, oldest first: newer rows and deletions hide older rows."""
    out = layers[0][0]
    for rows, deleted in layers[1:]:
        hidden = rows.select("path") if deleted is None else rows.select("path").unionByName(deleted.select("path"))
        out = out.join(hidden, "path", "left_anti").unionByName(rows.select(*out.columns))
    return out


def first_seen(files: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per identity: the first path, the last size and time."""
    has_time = "mtime" in files.columns
    last = [F.max_by("size", seq).alias("size"), *([F.max_by("mtime", seq).alias("mtime")] if has_time else [])]
    return files.groupBy(*KEY).agg(F.min_by("path", seq).alias("path"), *last)


def parents_applied(base: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """A directory's entries (parent, path) with some added, then some removed."""
    both = base.select("parent", "path").unionByName(added.select("parent", "path")).distinct()
    return both.join(removed.select("parent", "path"), ["parent", "path"], "left_anti")


def admit(delta_paths: DataFrame, batch: DataFrame, most: int = MOST_PATHS) -> tuple[DataFrame, bool]:
    """The leading part of a batch that the delta has room for, and whether that is all.

    Paths already in the delta take no room; the batch stops at the first path
    without room.
    """
    room = most - delta_paths.count()
    fresh = batch.groupBy("path").agg(F.min("seq").alias("seq")).join(delta_paths.select("path"), "path", "left_anti")
    over = fresh.orderBy("seq").limit(max(room, 0) + 1).agg(F.max("seq"), F.count(F.lit(1))).first()
    if over[1] <= max(room, 0):
        return batch, True
    return batch.where(F.col("seq") < over[0]), False
