"""Queries of the data-preparation operators in the core."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators import heavy_keys, incremental, orphans
from corvine.session import checkpoint_dir
from corvine.sources.tables import table

HEAVY_SHARE = 0.02


def _callees(spark: SparkSession, base: str) -> DataFrame:
    return heavy_keys.per_key_summary(table(spark, base, "call_edges"), "callee_id", "caller_id", "id", "created_at")


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return heavy_keys.heavy_keys(_callees(spark, base), HEAVY_SHARE).select(F.col("key").alias("callee_id"))


def p1_callee_summary(spark: SparkSession, base: str) -> DataFrame:
    return _callees(spark, base).filter(F.col("key").isNotNull()).select(F.col("key").alias("callee_id"), F.col("n_items").alias("n_edges"), F.col("n_members").alias("n_callers"), F.unix_micros("last_ts").alias("last_created_us"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return incremental.pending_content(*(table(spark, base, t) for t in ("indexed_content", "content_ledger", "index_run")))


def _feed_job(spark: SparkSession, base: str) -> tuple[incremental.IncrementalJob, int, int]:
    """A job over the feed of versions by day: a run as of the last completed run, one over everything that dies, and its repeat.

    With the number of days and of those that the second run had to derive.
    """
    feed = table(spark, base, "indexed_content").select(F.col("id").alias("content_id"), F.lower("content_hash").alias("content_hash"), "updated_at").distinct()
    derive = lambda df: df.withColumn("digest", F.md5("content_hash"))
    job = incremental.IncrementalJob(spark, f"{checkpoint_dir(spark)}/feed-{uuid.uuid4().hex}", "content_id", "content_hash", derive, F.date_format("updated_at", "yyyy-MM-dd"))
    last = table(spark, base, "index_run").filter("status = 'completed'").agg(F.max("started_at").alias("t"))
    job.run(feed.filter(F.col("updated_at") < last.scalar()))
    job.stage(feed)  # dies before the commit
    again = job.stage(feed)
    job.commit(again)
    if job.run(feed):
        raise AssertionError("a repeat found something to do")
    return job, again.n_parts, again.n_changed


def p4_replaced(spark: SparkSession, base: str) -> DataFrame:
    """The derived table of a job that ran over the early versions, then died over all of them and ran again."""
    rows = _feed_job(spark, base)[0].rows()
    if rows is None:
        return spark.createDataFrame([], "content_id long, content_hash string, updated_us long, digest string")
    return rows.select("content_id", "content_hash", F.unix_micros("updated_at").alias("updated_us"), "digest")


def p4_skipped(spark: SparkSession, base: str) -> DataFrame:
    """How many partitions the second run of the same job skipped."""
    _, n_parts, n_changed = _feed_job(spark, base)
    return spark.createDataFrame([(n_parts, n_changed, n_parts - n_changed)], "n_parts long, n_derived long, n_skipped long")


def _edge_orphans(spark: SparkSession, base: str) -> DataFrame:
    return orphans.orphans(table(spark, base, "call_edges"), "id", ["caller_id", "callee_id"], "created_at", table(spark, base, "symbol"), "id", "indexed_at", "deleted_at")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return _edge_orphans(spark, base).select(F.col("ref_id").alias("edge_id"), "ref_field", "orphan_kind")


def p5_by_month(spark: SparkSession, base: str) -> DataFrame:
    counts = orphans.orphans_by_period(_edge_orphans(spark, base))
    return counts.select("ref_field", "orphan_kind", F.date_format("period", "yyyy-MM").alias("month"), F.col("n_refs").alias("n_edges"))


QUERIES = {f.__name__: f for f in (p1_found, p1_callee_summary, p4_found, p4_replaced, p4_skipped, p5_found, p5_by_month)}

_ORPHANS = """
WITH edge AS (SELECT DISTINCT id, caller_id, callee_id, created_at FROM call_edges),
ref AS (
  SELECT id AS edge_id, 'caller_id' AS ref_field, caller_id AS k, created_at AS t FROM edge WHERE caller_id IS NOT NULL
  UNION ALL SELECT id, 'callee_id', callee_id, created_at FROM edge WHERE callee_id IS NOT NULL),
seen AS (
  SELECT edge_id, ref_field, t, count(s.id) AS n_rows,
         count(CASE WHEN s.indexed_at <= t THEN 1 END) AS n_begun,
         count(CASE WHEN s.indexed_at <= t AND (s.deleted_at IS NULL OR t < s.deleted_at) THEN 1 END) AS n_alive
  FROM ref LEFT JOIN symbol s ON s.id = ref.k GROUP BY edge_id, ref_field, t),
orphan AS (
  SELECT edge_id, ref_field, t, CASE WHEN n_rows = 0 THEN 'missing' WHEN n_begun > 0 THEN 'deleted' ELSE 'late' END AS orphan_kind
  FROM seen WHERE n_alive = 0)
"""

SQL = {
    "p1_found": f"""
WITH edge AS (SELECT DISTINCT id, callee_id, caller_id FROM call_edges)
SELECT callee_id FROM edge WHERE callee_id IS NOT NULL
GROUP BY callee_id HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM edge)""",
    "p1_callee_summary": """
SELECT callee_id, count(DISTINCT id) AS n_edges, count(DISTINCT caller_id) AS n_callers, epoch_us(max(created_at)) AS last_created_us
FROM call_edges WHERE callee_id IS NOT NULL GROUP BY callee_id""",
    "p4_found": """
WITH cur AS (SELECT id, lower(arg_max(content_hash, updated_at)) AS h FROM indexed_content GROUP BY id),
done AS (
  SELECT content_id, lower(arg_max(content_hash, processed_at)) AS h FROM content_ledger
  WHERE outcome = 'ok' AND run_id IN (SELECT run_id FROM index_run WHERE status = 'completed') GROUP BY content_id)
SELECT cur.id AS content_id, cur.h AS content_hash FROM cur LEFT JOIN done ON done.content_id = cur.id
WHERE done.content_id IS NULL OR cur.h <> done.h""",
    "p4_replaced": """
SELECT DISTINCT id AS content_id, lower(content_hash) AS content_hash, epoch_us(updated_at) AS updated_us, md5(lower(content_hash)) AS digest
FROM indexed_content WHERE id IS NOT NULL""",
    "p4_skipped": """
WITH c AS (SELECT max(started_at) AS cut FROM index_run WHERE status = 'completed'),
d AS (SELECT strftime(updated_at, '%Y-%m-%d') AS day, coalesce(bool_or(updated_at >= cut), true) AS late FROM indexed_content, c WHERE id IS NOT NULL GROUP BY 1)
SELECT count(*) AS n_parts, count(CASE WHEN late THEN 1 END) AS n_derived, count(CASE WHEN NOT late THEN 1 END) AS n_skipped FROM d""",
    "p5_found": _ORPHANS + "SELECT edge_id, ref_field, orphan_kind FROM orphan",
    "p5_by_month": _ORPHANS + "SELECT ref_field, orphan_kind, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_edges FROM orphan GROUP BY 1, 2, 3",
}
