"""Canonical tables over the test tables, and the same as SQL for the checks.

Re-delivered rows are dropped here. Of several rows of one id the latest is the
row of the view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.sources.tables import latest_rows, table

_LATE = lambda c: F.col(c).desc_nulls_last()


def symbols(spark: SparkSession, base: str) -> DataFrame:
    return latest_rows(table(spark, base, "symbol"), "id", [_LATE("indexed_at"), _LATE("start_line"), F.col("name").desc()])


def files(spark: SparkSession, base: str) -> DataFrame:
    rows = latest_rows(table(spark, base, "source_file"), "id", [_LATE("indexed_at"), F.col("path").asc()])
    return rows.withColumn("sha", F.lower("sha"))


def edges(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "call_edges").dropDuplicates(["id"])


def content(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "indexed_content")
    return latest_rows(rows, "id", [_LATE("updated_at"), F.lower("content_hash").desc_nulls_last()])


def chunks(spark: SparkSession, base: str) -> DataFrame:
    return latest_rows(table(spark, base, "vector_embedding"), "id", [_LATE("created_at"), _LATE("content_id"), _LATE("chunk_index")])


def graph(spark: SparkSession, base: str) -> DataFrame:
    """``src, dst``: distinct calls between known ids."""
    return table(spark, base, "call_edges").filter("caller_id IS NOT NULL AND callee_id IS NOT NULL").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")).distinct()


def query_log(spark: SparkSession, base: str) -> DataFrame:
    """The event table read as a query log."""
    return table(spark, base, "events").select("event_id", "ts", F.col("user_id").alias("user"), F.col("event_type").alias("query_type"), F.col("value").alias("latency_ms"), "props")


SYM = "sym AS (SELECT * FROM symbol QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, start_line DESC NULLS LAST, name DESC) = 1)"
FILE = "file AS (SELECT * REPLACE (lower(sha) AS sha) FROM source_file QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, path) = 1)"
EDGE = "edge AS (SELECT DISTINCT * FROM call_edges)"
DOC = "doc AS (SELECT * FROM indexed_content QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, lower(content_hash) DESC NULLS LAST) = 1)"
CHUNK = "chunk AS (SELECT * FROM vector_embedding QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, content_id DESC NULLS LAST, chunk_index DESC NULLS LAST) = 1)"
GRAPH = "g AS (SELECT DISTINCT caller_id AS src, callee_id AS dst FROM call_edges WHERE caller_id IS NOT NULL AND callee_id IS NOT NULL)"
LOG = "log AS (SELECT event_id, ts, user_id AS \"user\", event_type AS query_type, value AS latency_ms, props FROM events)"


def with_(*parts: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + "\n"
