"""Reading and writing small files wherever Spark can write."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Store:
    """A folder on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def lengths(self, name: str) -> dict[str, int]:
        """Names and lengths of the data files of a folder."""
        found = self._fs.listStatus(self._path(name)) if self.exists(name) else []
        return {s.getPath().getName(): s.getLen() for s in found if not s.getPath().getName().startswith(("_", "."))}

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def rename(self, old: str, new: str) -> bool:
        return self._fs.rename(self._path(old), self._path(new))

    def write_json(self, name: str, value: dict) -> None:
        """Writes aside and renames, so that readers see the old or the new content."""
        aside = f"{name}.tmp"
        out = self._fs.create(self._path(aside), True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        self.delete(name)
        self.rename(aside, name)

    def read_json(self, name: str) -> dict | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(name))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None
