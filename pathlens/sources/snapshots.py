"""Versioned snapshots of a file table, and the log of changes since.

Layout: ``versions/<n>/`` (Parquet, sorted by path inside files), one
``versions/<n>.json`` per version (lengths of files, row count, checksum, roots, sealed log id),
``manifest.json`` (current and previous version), ``wal/seal=<id>/`` (events by
log segment; the open one has the id after the last seal), ``state.json``.
A version counts only once its manifest entry is there, and is read only if its
files have the lengths that were noted; else the one before is used, else none.
Rows are read back and counted when a version is written; ``valid(n, deep=True)``
compares them again.
"""

from __future__ import annotations

import time
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlens.functions.paths import normalize
from pathlens.operators import events as ev
from pathlens.operators.overlay import visible_files, with_key

from .storage import Store

FLUSH_PATHS, FLUSH_BYTES = 250_000, 64 * 1024 * 1024
PERIODIC_EVENTS, PERIODIC_BYTES, LEAST_SECONDS = 4_096, 4 * 1024 * 1024, 10
KEEP = 2


class ConflictError(RuntimeError):
    """The manifest changed since the version was begun."""


def should_flush(paths: int, size: int) -> bool:
    return paths >= FLUSH_PATHS or size >= FLUSH_BYTES


def should_snapshot(events: int, size: int, seconds: float) -> bool:
    return seconds >= LEAST_SECONDS and (events >= PERIODIC_EVENTS or size >= PERIODIC_BYTES)


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free checksum."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def normal_roots(roots: list[str]) -> list[str]:
    """Composed, without a final slash, in order, each once, after the root of all."""
    return sorted({"/", *(unicodedata.normalize("NFC", r).rstrip("/") or "/" for r in roots)})


class Snapshots:
    def __init__(self, spark: SparkSession, base: str, roots: list[str] | None = None):
        self.spark, self.store = spark, Store(spark, base)
        self.roots = normal_roots(roots or [])

    # versions

    def manifest(self) -> dict:
        return self.store.read_json("manifest.json") or {"versions": []}

    def write(self, files: DataFrame, sealed: int = 0, expect: list[int] | None = None, note: dict | None = None) -> int:
        """A new current version; ``expect`` is the manifest that the caller started from, ``note`` is kept with the version."""
        before = self.manifest()["versions"]
        if expect is not None and before != expect:
            raise ConflictError(f"expected versions {expect}, found {before}")
        n = max(before, default=0) + 1
        folder = f"{self.store.base}/versions/{n}"
        table = normalize(files)
        table.repartitionByRange(F.col("path")).sortWithinPartitions("path").write.mode("overwrite").parquet(folder)
        count, checksum = fingerprint(self.spark.read.parquet(folder))
        self.store.write_json(f"versions/{n}.json", {"count": count, "checksum": str(checksum), "roots": self.roots, "sealed": sealed, "files": self.store.lengths(f"versions/{n}"), "written": int(time.time()), "note": note or {}})
        if not self.valid(n):
            raise RuntimeError(f"version {n} does not read back")
        if expect is not None and self.manifest()["versions"] != expect:
            raise ConflictError("another writer was faster")
        kept = [n, *before][:KEEP]
        self.store.write_json("manifest.json", {"versions": kept})
        for old in before:
            if old not in kept:
                self.store.delete(f"versions/{old}")
                self.store.delete(f"versions/{old}.json")
        return n

    def valid(self, n: int, deep: bool = False) -> bool:
        """Whether a version is whole: its files have the lengths that were noted; if ``deep``, also count and checksum of all rows."""
        note = self.store.read_json(f"versions/{n}.json")
        if not note or note["roots"] != self.roots or not self.store.exists(f"versions/{n}/_SUCCESS") or self.store.lengths(f"versions/{n}") != note["files"]:
            return False
        if not deep:
            return True
        try:
            count, checksum = fingerprint(self.spark.read.parquet(f"{self.store.base}/versions/{n}"))
        except Exception:  # a damaged file shows as some error of the reader
            return False
        return count == note["count"] and str(checksum) == note["checksum"]

    def load(self) -> tuple[DataFrame | None, int, int]:
        """(files, version, sealed log id) of the newest version that is whole; (None, 0, 0) without one."""
        for n in self.manifest()["versions"]:
            if self.valid(n):
                return self.spark.read.parquet(f"{self.store.base}/versions/{n}"), n, self.store.read_json(f"versions/{n}.json")["sealed"]
        return None, 0, 0

    def clean(self) -> None:
        """Removes versions that no manifest names, and files written aside."""
        named = {str(n) for n in self.manifest()["versions"]}
        for name in self.store.names("versions"):
            if name.removesuffix(".json") not in named:
                self.store.delete(f"versions/{name}")
        for name in self.store.names():
            if name.endswith(".tmp"):
                self.store.delete(name)

    # log

    def sealed(self) -> int:
        return (self.store.read_json("wal/sealed.json") or {"id": 0})["id"]

    def append(self, events: DataFrame) -> None:
        """Adds events to the open log segment."""
        events.write.mode("append").parquet(f"{self.store.base}/wal/seal={self.sealed() + 1}")

    def seal(self) -> int:
        """Closes the open segment; events that come later have the next id."""
        n = self.sealed() + 1
        self.store.write_json("wal/sealed.json", {"id": n})
        return n

    def replay(self, since: int) -> DataFrame | None:
        """Events of all segments after seal ``since``; only those folders are read."""
        ids = sorted(int(n.split("=")[1]) for n in self.store.names("wal") if n.startswith("seal="))
        paths = [f"{self.store.base}/wal/seal={n}" for n in ids if n > since]
        return self.spark.read.parquet(*paths) if paths else None

    def recover(self, since: int) -> tuple[DataFrame | None, int]:
        """Like ``replay``, leaving out files that cannot be read, and how many those are.

        Any such file means that the log is not whole, and a repair scan is due.
        """
        log = self.replay(since)
        if log is None:
            return None, 0
        reader = self.spark.read.schema(log.schema).option("ignoreCorruptFiles", "true")
        rows = reader.parquet(*{f.rsplit("/", 1)[0] for f in log.inputFiles()})
        read = rows.groupBy(F.input_file_name().alias("f")).agg(F.max(F.xxhash64(*log.columns)))  # all columns, so that damage shows
        whole = {r.f for r in read.collect()}
        kept = self.spark.read.schema(log.schema).parquet(*sorted(whole)) if whole else log.limit(0)
        return kept, len(set(log.inputFiles()) - whole)

    def forget(self, up_to: int) -> None:
        """Deletes the segments that a snapshot has taken in."""
        for name in self.store.names("wal"):
            if name.startswith("seal=") and int(name.split("=")[1]) <= up_to:
                self.store.delete(f"wal/{name}")

    def reset(self) -> None:
        """Forgets all versions and the whole log; the next segment has a new id."""
        n = self.seal()
        self.store.write_json("manifest.json", {"versions": []})
        self.forget(n)
        self.clean()

    def cutoff_ns(self) -> int:
        """When the newest whole version was written; 0 without one. What changed since is to be looked at again."""
        _, n, _ = self.load()
        return self.store.read_json(f"versions/{n}.json")["written"] * 10**9 if n else 0

    # both

    def current(self) -> DataFrame | None:
        """The files as the newest version and the log after it show them."""
        base, _, sealed = self.load()
        log = self.replay(sealed)
        if log is None:
            return base
        delta = with_key(ev.delta(log))
        if base is None:
            return delta.where("live AND size IS NOT NULL").select("dev", "ino", "generation", "path", "size")
        return visible_files(base.select("dev", "ino", "generation", "path", "size", *(c for c in ("mtime",) if c in base.columns)), delta)

    def taken_in(self, stream: str) -> int:
        """The last batch of a stream that the current version holds; -1 if none."""
        for n in self.manifest()["versions"][:1]:
            note = (self.store.read_json(f"versions/{n}.json") or {}).get("note", {})
            if note.get("stream") == stream:
                return note["batch"]
        return -1

    def compact(self, note: dict | None = None) -> int:
        """Seals the log, writes base and log as a new version, and drops what it took in."""
        expect = self.manifest()["versions"]
        n = self.seal()
        files = self.current()
        if files is None:
            return 0
        version = self.write(files, n, expect, note)
        self.forget(n)
        return version

    def rebuild(self, scan, begun_seal: int | None = None) -> int:
        """A new version from a full scan; events that were logged since it began stay in the log and count on top."""
        n = self.seal() if begun_seal is None else begun_seal
        held = self.manifest()["versions"][:1]
        version = self.write(scan(), n, note=(self.store.read_json(f"versions/{held[0]}.json") or {}).get("note") if held else None)
        self.forget(n)
        return version

    # runtime state

    def save_state(self, clean: bool) -> None:
        self.store.write_json("state.json", {"last_clean_shutdown": clean, "last_snapshot": int(time.time()), "last_seal": self.sealed()})

    def trusted(self) -> bool:
        """Whether the last run ended well; a missing state is not trusted."""
        return bool((self.store.read_json("state.json") or {}).get("last_clean_shutdown"))
