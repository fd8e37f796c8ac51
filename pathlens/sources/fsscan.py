"""A data source that reads file metadata: ``spark.read.format("fsmeta")``.

Options: ``roots`` (separated by newlines), ``hidden``, ``follow_links`` (default
false), ``ignore`` (default true), ``exclude_dirs`` (separated by commas; empty
for none), ``max_depth``, ``kind`` (``files``: regular files; ``entries``:
everything but directories; ``dirs``: directories). The driver opens folders from
the roots down until there are enough to share out as partitions, so large trees
are read in parallel however they are shaped. Ignore files count in every folder,
as do the user's own rules. Unreadable places are left out. The paths must be
visible to the executors.
"""

from __future__ import annotations

import os
import stat
import unicodedata
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pathlens.functions.exclude import DEFAULT_DIRS, clean_names

from .ignore import Stack

SCHEMA = "dev long, ino long, generation int, path string, size long, mtime timestamp, ctime timestamp, atime timestamp, mtime_ns long"
MOST_DEPTH = 255
#: Folders that the driver opens to find some to share out, and partitions at most.
SPREAD, MOST_PARTS = 256, 4096
#: Paths that one report may ask for.
MOST_PATHS = 10


@dataclass
class Part(InputPartition):
    """Folders to read: (root, folder, whether with what lies below)."""

    starts: tuple[tuple[str, str, bool], ...]


def _truth(value: str | None, default: bool) -> bool:
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")


class FsMetaReader(DataSourceReader):
    def __init__(self, options: dict):
        o = {k.lower(): v for k, v in options.items()}
        self.roots = [unicodedata.normalize("NFC", r) for r in o.get("roots", o.get("path", "")).split("\n") if r]
        self.hidden, self.links, self.ignore = _truth(o.get("hidden"), False), _truth(o.get("follow_links"), False), _truth(o.get("ignore"), True)
        self.excluded = set(clean_names(o["exclude_dirs"].split(",") if "exclude_dirs" in o else list(DEFAULT_DIRS)))
        self.depth, self.kind = int(o.get("max_depth", MOST_DEPTH)), o.get("kind", "files")

    def partitions(self) -> list[InputPartition]:
        """Folders are opened here, breadth first, until there are ``SPREAD`` to share out; the rest is read in tasks."""
        starts: list[tuple[str, str, bool]] = []
        queue = deque((root, root, 0, self._rules(root, root)) for root in self.roots)
        opened = 0
        while queue and opened < SPREAD and len(queue) < SPREAD:
            root, folder, level, rules = queue.popleft()
            starts.append((root, folder, False))
            opened += 1
            if level + 1 < self.depth:
                below = [e for e in self._entries(folder, rules) if self._is_dir(e)]
                queue.extend((root, e.path, level + 1, rules.into(e.path)) for e in below if not e.is_symlink())
                # a link may lead back to where it lies; a walk that knows its way finds out
                starts += [(root, e.path, True) for e in below if e.is_symlink()]
        starts += [(root, folder, True) for root, folder, *_ in queue]
        parts = min(len(starts), MOST_PARTS)
        return [Part(tuple(starts[i::parts])) for i in range(parts)] or [Part(())]

    def _rules(self, root: str, folder: str) -> Stack:
        return Stack.of(root, folder) if self.ignore else _NoRules()

    def _is_dir(self, entry: os.DirEntry) -> bool:
        try:
            return entry.is_dir(follow_symlinks=self.links)
        except OSError:
            return False

    def _entries(self, folder: str, rules) -> list[os.DirEntry]:
        """What counts in a folder, by name."""
        try:
            with os.scandir(folder) as found:
                entries = sorted(found, key=lambda e: e.name)
        except OSError:
            return []
        return [e for e in entries if not self._skips(e, rules, self._is_dir(e))]

    def _skips(self, entry: os.DirEntry, rules, is_dir: bool) -> bool:
        if not self.hidden and entry.name.startswith("."):
            return True
        return (is_dir and entry.name in self.excluded) or rules.ignores(entry.path, is_dir)

    def _walk(self, folder: str, rules, depth: int, seen: frozenset) -> Iterator[os.DirEntry]:
        for e in self._entries(folder, rules):
            yield e
            if depth > 1 and self._is_dir(e):
                try:
                    s = e.stat(follow_symlinks=self.links)
                except OSError:
                    continue
                if (s.st_dev, s.st_ino) not in seen:
                    yield from self._walk(e.path, rules.into(e.path), depth - 1, seen | {(s.st_dev, s.st_ino)})

    def read(self, partition: Part) -> Iterator[tuple]:
        import datetime as dt

        at = lambda t: dt.datetime.fromtimestamp(t, dt.UTC)
        for root, folder, deep in partition.starts:
            names = folder[len(root.rstrip("/")) :].strip("/").split("/") if folder != root else []
            above = {_identity("/".join([root.rstrip("/"), *names[:i]]) or "/") for i in range(len(names))}
            if names and _identity(folder) in above:
                continue
            for e in self._walk(folder, self._rules(root, folder), self.depth - len(names) if deep else 1, frozenset(above | {_identity(folder)})):
                try:
                    s = e.stat(follow_symlinks=self.links)
                except OSError:
                    continue
                is_dir = stat.S_ISDIR(s.st_mode)
                if {"files": not stat.S_ISREG(s.st_mode), "entries": is_dir, "dirs": not is_dir}[self.kind]:
                    continue
                born = getattr(s, "st_birthtime", None)
                yield (s.st_dev, s.st_ino, 0, unicodedata.normalize("NFC", e.path), s.st_size, at(s.st_mtime), born and at(born), at(s.st_atime), s.st_mtime_ns if s.st_mtime_ns >= 0 else None)


def _identity(folder: str) -> tuple[int, int] | None:
    try:
        s = os.stat(folder)
    except OSError:
        return None
    return s.st_dev, s.st_ino


class _NoRules:
    def into(self, folder: str) -> _NoRules:
        return self

    def ignores(self, path: str, is_dir: bool) -> bool:
        return False


class FsMetaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fsmeta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FsMetaReader(self.options)


def scan(spark: SparkSession, roots: list[str], **options) -> DataFrame:
    """The files under ``roots``, one row per identity (the first path stays)."""
    spark.dataSource.register(FsMetaSource)
    reader = spark.read.format("fsmeta").option("roots", "\n".join(roots))
    for k, v in options.items():
        reader = reader.option(k, ",".join(v) if isinstance(v, list | tuple) else str(v).lower())
    rows = reader.load()
    rest = [c for c in rows.columns if c not in ("dev", "ino", "generation")]
    if options.get("kind", "files") != "files":
        return rows
    first = rows.groupBy("dev", "ino", "generation").agg(F.min_by(F.struct(*rest), "path").alias("r"))
    return first.select("dev", "ino", "generation", *(F.col(f"r.{c}").alias(c) for c in rest))


def scan_report(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """One row: how many entries a scan of at most ten paths found, and how long it took."""
    import time

    if not 0 < len(paths) <= MOST_PATHS:
        raise ValueError(f"between 1 and {MOST_PATHS} paths can be scanned, not {len(paths)}")
    began = time.monotonic()
    n = scan(spark, paths, **options).count()
    return spark.createDataFrame([(n, int((time.monotonic() - began) * 1000))], "scanned long, elapsed_ms long")
