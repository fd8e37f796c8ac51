"""Shared helpers: intermediate tables, and columns of names that are free."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE_RUNS = r"[^\x20\x09-\x0D]+"


#: Spark deletes shuffle files once the driver has collected what holds them; so often is that asked for.
SWEEP_SECONDS = 2.0


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set, a temporary one in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="pathlens-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Work:
    """Intermediate tables of one run, kept in the shared folder.

    ``save`` writes a DataFrame as Parquet and reads it back, which cuts its
    lineage: a lost executor costs the tasks that read it, not those before.
    """

    swept = 0.0

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.base}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the files of tables that ``save`` returned, and lets Spark delete the
        shuffle files of what was computed from them and is no longer held."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
            where = jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(conf).delete(where, True)
        if time.monotonic() - Work.swept > SWEEP_SECONDS:
            gc.collect()
            jvm.System.gc()
            Work.swept = time.monotonic()


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores added until ``df`` has no column of that name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row, so that rows which repeat have an order."""
    odd = re.compile("map<|variant")
    return F.xxhash64(*(F.to_json(F.struct(F.col(quoted(f.name)))) if odd.search(f.dataType.simpleString()) else F.col(quoted(f.name)) for f in df.schema.fields))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))
