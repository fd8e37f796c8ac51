"""File and event tables derived from the sample tables, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FILES = """
SELECT CAST(1 AS BIGINT) AS dev, doc_id AS ino, CAST(0 AS INT) AS generation,
  concat('/corpus/', source, '/', lang, '/',
    CASE WHEN doc_id % 11 = 0 THEN 'node_modules/lib/' WHEN doc_id % 13 = 0 THEN '.cfg_dir/' WHEN doc_id % 17 = 0 THEN 'target/debug/' ELSE '' END,
    CASE WHEN doc_id % 5 = 0 THEN 'VCP_Doc_' WHEN doc_id % 7 = 0 THEN '.env_' WHEN doc_id % 19 = 0 THEN '文档_' WHEN doc_id % 3 = 0 THEN 'myTestFile-' ELSE 'doc_' END,
    lpad(CAST(doc_id AS VARCHAR(20)), 6, '0'),
    CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.PDF' WHEN 3 THEN '.rs' WHEN 4 THEN '.tar.gz' WHEN 5 THEN '.jpg' WHEN 6 THEN '.mp4' ELSE '' END) AS path,
  n_chars AS size,
  CASE WHEN doc_id % 23 = 0 THEN NULL ELSE TIMESTAMP_NTZ_LIT + (doc_id % 2000) * INTERVAL '1' HOUR END AS mtime
FROM documents
"""
FS_EVENTS = """
SELECT event_id + 1 AS seq, ts,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'rename' ELSE 'modify' END AS event_type,
  concat('/events/u', CAST(user_id AS VARCHAR(20)), '/f', CAST(event_id % 7 AS VARCHAR(20)), '.dat') AS path,
  CASE WHEN event_type = 'purchase' THEN concat('/events/u', CAST(user_id AS VARCHAR(20)), '/f', CAST((event_id + 3) % 7 AS VARCHAR(20)), '.dat') END AS from_path,
  user_id * 7 + event_id % 7 AS ino, CAST(floor(value) AS BIGINT) AS size
FROM events
"""
FILES_SPARK = _FILES.replace("TIMESTAMP_NTZ_LIT", "TIMESTAMP_NTZ '2024-01-01 00:00:00'")
FILES_DUCKDB = _FILES.replace("TIMESTAMP_NTZ_LIT", "TIMESTAMP '2024-01-01 00:00:00'")


def _over(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, "documents", FILES_SPARK)


def fs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the stat payload of their path (dev 1, generation 0)."""
    return _over(spark, sf_dir, "events", FS_EVENTS)
