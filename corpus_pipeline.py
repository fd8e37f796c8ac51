"""A corpus pipeline: from raw documents to a token store.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. The first four return
the columns of ``documents``; the last returns the digests of the token store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathlens.llm import decontaminate, jaccard_join, mixing, quality, token_store
from pathlens.llm.catalog import table, tokenizer_file
from pathlens.llm.work import Work


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality classifier scores below its cut."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return jaccard_join.keep_first(docs)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources reach their target weights."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes into the content-addressed store, and reads it back."""
    return token_store.encode_and_read(docs, tokenizer_file())


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_first),
    ("benchmark decontamination", keep_unleaked),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", encode),
]
#: SQL can express neither the classifier nor the tokenizer; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    work = Work(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name.replace(" ", "-").replace("/", ""))
    return STAGES[-1][1](spark, docs, sf_dir)
