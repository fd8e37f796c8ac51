"""Keeping a file table current from a stream of change events.

Renames are paired across micro-batches in state. Each micro-batch is filtered
(excluded directories, ignore rules, own writes), completed with what lies in
directories that have appeared, coalesced and appended to the log; when enough
has gathered, or the log holds as many paths as it may, log and base are
compacted into a new snapshot. A batch that comes again writes the same log
folder again, or is left out if a snapshot has taken it in: versions name the
last batch in them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pathlens.functions.exclude import excluded
from pathlens.functions.paths import components, is_under, nfc_column
from pathlens.operators import events as ev
from pathlens.operators.overlay import MOST_PATHS
from pathlens.sources.ignore import IgnoreFilter
from pathlens.sources.snapshots import Snapshots, should_flush, should_snapshot
from pathlens.sources.storage import Store

#: How long a batch gathers; with ``priority``, so that creations show sooner.
DEBOUNCE_MS, CREATE_MS = 50, 5
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def wanted(path: Column, exclude_dirs: list[str] | None = None, own: list[str] | None = None) -> Column:
    """Events that count: not below excluded directories, nor the engine's own writes."""
    keep = ~excluded(components(path), exclude_dirs)
    for prefix in own or []:
        keep &= ~is_under(path, prefix)
    return keep


def prepared(raw: DataFrame, exclude_dirs: list[str] | None = None, own: list[str] | None = None, ignored: Column | None = None) -> DataFrame:
    """Raw events with composed paths, without those that do not count."""
    rows = raw.withColumn("path", nfc_column("path")).where(wanted(F.col("path"), exclude_dirs, own))
    return rows if ignored is None else rows.where(~ignored)


def pair_renames_in_state(raw: DataFrame, seconds: int = ev.PAIR_SECONDS) -> DataFrame:
    """Rename halves of a stream paired across micro-batches, by cookie; other columns are kept, ``cookie`` goes.

    The last unpaired source of a cookie is kept in state for ``seconds`` of
    processing time and then forgotten without an event.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").to_dict("records"):
            at = int(row["ts"].timestamp() * 1000)
            if row["event_type"] == "rename_from":
                held = (row["path"], at)
                continue
            near = held is not None and at < held[1] + seconds * 1000
            out.append(("rename" if near else "modify", held[0] if near else None, row["payload"]))
            held = None
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update(held)
            state.setTimeoutDuration(seconds * 1000)
        if out:
            yield pd.DataFrame(out, columns=["event_type", "from_path", "payload"], dtype=object)

    rest = [f for f in raw.schema.fields if f.name not in ("cookie", "event_type", "from_path")]
    columns = [*(F.col(f.name) for f in rest), "event_type", "from_path"]
    half = F.col("event_type").isin("rename_from", "rename_to")
    # the payload passes Python as a string, so that its numbers keep all their digits
    halves = raw.where(half & F.col("cookie").isNotNull()).select("cookie", "seq", "ts", "event_type", "path", F.to_json(F.struct(*(f.name for f in rest)), _MICROS).alias("payload"))
    paired = halves.groupBy("cookie").applyInPandasWithState(step, "event_type string, from_path string, payload string", "path string, at long", "append", "ProcessingTimeTimeout")
    whole = paired.withColumn("payload", F.from_json("payload", T.StructType(rest), _MICROS)).select("payload.*", "event_type", "from_path")
    plain = raw.where(~half) if "from_path" in raw.columns else raw.where(~half).withColumn("from_path", F.lit(None).cast("string"))
    # a half without a cookie can't be paired
    lone = raw.where(half & F.col("cookie").isNull()).withColumn("event_type", F.lit("modify")).withColumn("from_path", F.lit(None).cast("string"))
    return plain.select(*columns).unionByName(lone.select(*columns)).unionByName(whole.select(*columns))


def _no_dir() -> Column:
    return ~F.coalesce(F.col("is_dir"), F.lit(False))


def discovered(batch: DataFrame, scan_dirs: Callable[[list[str]], DataFrame], most: int = 10) -> tuple[DataFrame | None, bool]:
    """Creations for what lies in directories (``is_dir``) that appear in a batch, and whether all were read.

    At most ``most`` directories are read here; where there are more, a scan of the whole is due.
    """
    new = batch.where("is_dir AND event_type IN ('create', 'rename')").select("path").distinct()
    dirs = [r.path for r in new.orderBy("path").limit(most + 1).collect()]
    if not dirs:
        return None, True
    found = scan_dirs(dirs[:most])
    return found.withColumn("event_type", F.lit("create")), len(dirs) <= most


class RebuildGate:
    """Lets one rebuild run at a time, at least ``cooldown`` seconds apart; requests in between become one."""

    def __init__(self, cooldown: float = 60.0):
        self.cooldown, self.last, self.running, self.asked = cooldown, float("-inf"), False, False

    def request(self, now: float) -> bool:
        if self.running or now - self.last < self.cooldown:
            self.asked = True
            return False
        self.running, self.asked, self.last = True, False, now
        return True

    def finished(self, now: float) -> bool:
        """Ends a rebuild; whether another one was asked for meanwhile."""
        self.running, self.last = False, now
        return self.asked


@dataclass
class Pipeline:
    """A running table: snapshots, and what has gathered since the last one.

    ``scan_dirs(dirs)`` reads directories that have appeared, ``rebuild()`` all;
    without them nothing is read besides the events.
    """

    snapshots: Snapshots
    exclude_dirs: list[str] | None = None
    own: list[str] | None = None
    pair: bool = False
    flush: Callable[[int, int], bool] = should_flush
    periodic: Callable[[int, int, float], bool] = should_snapshot
    ignore: IgnoreFilter | None = None
    scan_dirs: Callable[[list[str]], DataFrame] | None = None
    rebuild: Callable[[], DataFrame] | None = None
    gate: RebuildGate = field(default_factory=RebuildGate)
    most_paths: int = MOST_PATHS
    clock: Callable[[], float] = time.monotonic
    paths: int = 0
    size: int = 0
    stream: str | None = None
    counts: dict = field(default_factory=lambda: {"batches": 0, "kept": 0, "compactions": 0, "rebuilds": 0})

    def __post_init__(self) -> None:
        self.compacted = self.clock()
        log = self.snapshots.replay(self.snapshots.load()[2])
        if log is not None:
            self.paths, self.size = log.agg(F.count(F.lit(1)), F.coalesce(F.sum(ev.estimated_bytes()), F.lit(0))).first()

    def apply(self, batch: DataFrame, batch_id: int = 0, paired: bool = False) -> None:
        """One micro-batch: filter, pair, discover, coalesce, log, compact if due."""
        if self.stream is not None and self.snapshots.taken_in(self.stream) >= batch_id:
            return
        rows = prepared(batch, self.exclude_dirs, self.own, self.ignore.column() if self.ignore else None)
        if self.pair and not paired:
            rows = ev.pair_renames(rows)
        if "from_path" not in rows.columns:
            rows = rows.withColumn("from_path", F.lit(None).cast("string"))
        everything = True
        if self.scan_dirs is not None and "is_dir" in rows.columns:
            found, everything = discovered(rows, self.scan_dirs)
            rows = rows.where(_no_dir()) if found is None else self._with(rows, found)
        kept = ev.coalesce(ev.typed(rows)).persist()
        try:
            n, size = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(ev.estimated_bytes()), F.lit(0))).first()
            if n and self.paths + n > self.most_paths and self.paths:
                # the log is full: what it holds goes into the base first
                self._compact(batch_id - 1)
            if n:
                folder = f"{self.snapshots.store.base}/wal/seal={self.snapshots.sealed() + 1}/batch={batch_id}"
                kept.drop("cookie").write.mode("overwrite").parquet(folder)
        finally:
            kept.unpersist()
        self.paths, self.size = self.paths + n, self.size + size
        self.counts["batches"] += 1
        self.counts["kept"] += n
        if self.flush(self.paths, self.size) or self.periodic(self.paths, self.size, self.clock() - self.compacted):
            self._compact(batch_id)
        if self.rebuild is not None and (not everything or self.gate.asked) and self.gate.request(self.clock()):
            self.snapshots.rebuild(self.rebuild)
            self.gate.finished(self.clock())
            self.paths = self.size = 0
            self.counts["rebuilds"] += 1

    def _with(self, rows: DataFrame, found: DataFrame) -> DataFrame:
        """The batch without its directories, and creations of what was found in them, with later numbers."""
        top = rows.agg(F.max("seq"), F.max("ts") if "ts" in rows.columns else F.lit(None)).first()
        line = Window.orderBy("path")
        added = prepared(found, self.exclude_dirs, self.own, self.ignore.column() if self.ignore else None).withColumn("seq", F.lit(top[0] or 0) + F.row_number().over(line))
        added = added.withColumns({f.name: F.lit(top[1] if f.name == "ts" else None).cast(f.dataType) for f in rows.schema.fields if f.name not in added.columns})
        return rows.where(_no_dir()).unionByName(added.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema.fields)))

    def _compact(self, batch_id: int) -> None:
        self.snapshots.compact({"stream": self.stream, "batch": batch_id})
        self.paths = self.size = 0
        self.compacted = self.clock()
        self.counts["compactions"] += 1

    def start(self, stream: DataFrame, checkpoint: str, debounce_ms: int = DEBOUNCE_MS, once: bool = False, priority: bool = False) -> StreamingQuery:
        """The running query; ``priority`` shortens the time that events gather."""
        if self.pair:
            stream = pair_renames_in_state(stream)
        store = Store(stream.sparkSession, checkpoint)

        def each(batch: DataFrame, batch_id: int) -> None:
            # the query's id is kept with its checkpoint, so numbers of batches belong to it
            self.stream = (store.read_json("metadata") or {}).get("id")
            self.apply(batch, batch_id, paired=True)

        writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        wait = min(CREATE_MS, debounce_ms) if priority else debounce_ms
        if not once:
            return writer.trigger(processingTime=f"{wait} milliseconds").start()
        # sources of renames that still wait would call for batches without data for ever
        conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
        before = conf.get(name)
        conf.set(name, "false")
        try:
            return writer.trigger(availableNow=True).start()
        finally:
            conf.set(name, before)
