"""Processing only new or changed records.

Every partition of a table has a fingerprint: the number of its rows and the
sums of two independent row hashes. Sums are additive, so they are computed
map-side and don't depend on the order of rows. Partitions with equal
fingerprints hold the same (key, value) pairs and are skipped whole; the others
are derived anew from all their rows and replaced by one dynamic partition
overwrite. The fingerprints of what was done are stored beside the data, so a
run reads its new source once and nothing old.

What is skipped depends on partitions that follow change: a feed by its period
of arrival leaves old periods alone, buckets of ids are all touched as soon as a
few in a thousand ids change.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.session import checkpoint_dir

BUCKETS = 4096
_PRINTS = "part string, n long, sum_a decimal(38,0), sum_b decimal(38,0), made long"
_PART, _MADE, _DIR = "__part", "__made", "__dir"


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def latest_hash(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``key, value``: of each non-null key, the value of the row with the greatest ``order``.

    Values are lower-cased; of rows with the same order the greatest value is
    taken, so repeated rows have no effect. A null order comes before all others.
    """
    best = F.max(F.struct(F.col(order), F.lower(F.col(value)).alias(value)))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(best.alias("__best")).select(key, F.col(f"__best.{value}").alias(value))


def fingerprints(df: DataFrame, key: str, value: str, buckets: int = BUCKETS, by: Column | None = None) -> DataFrame:
    """``bucket, n, sum_a, sum_b`` of the (key, value) pairs, per bucket of the key or per ``by``.

    Two 64-bit hashes are summed as decimals, so nothing overflows.
    """
    salted = lambda salt: F.sum(F.xxhash64(F.lit(salt), F.col(key), F.col(value)).cast("decimal(38,0)"))
    return df.groupBy((bucket_of(key, buckets) if by is None else by).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), salted("a").alias("sum_a"), salted("b").alias("sum_b"))


def changed_buckets(now: DataFrame, before: DataFrame) -> DataFrame:
    """Buckets whose fingerprints differ or that only one side has."""
    same = [F.col(f"now.{c}").eqNullSafe(F.col(f"before.{c}")) for c in ("n", "sum_a", "sum_b")]
    joined = now.alias("now").join(before.alias("before"), F.col("now.bucket") == F.col("before.bucket"), "full")
    return joined.filter(~(same[0] & same[1] & same[2])).select(F.coalesce("now.bucket", "before.bucket").alias("bucket"))


def pending(current: DataFrame, handled: DataFrame, key: str, value: str, buckets: int = BUCKETS) -> DataFrame:
    """The (key, value) pairs of ``current`` that ``handled`` doesn't hold as they are.

    Both inputs have one row per key (see ``latest_hash``). Only buckets whose
    fingerprints differ are compared. A null value equals only a null value. An
    empty ``handled`` leaves everything pending, an empty ``current`` nothing.
    """
    current, handled = current.select(key, value), handled.select(key, value)
    changed = changed_buckets(fingerprints(current, key, value, buckets), fingerprints(handled, key, value, buckets))
    within = current.withColumn("bucket", bucket_of(key, buckets)).join(changed, "bucket", "left_semi")
    known = handled.select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    same = (F.col(key) == F.col("__key")) & F.col(value).eqNullSafe(F.col("__value"))
    return within.join(known, same, "left_anti").select(key, value)


def handled_by_completed_runs(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """``content_id, content_hash``: what the last ok row of a completed run says of each id.

    Rows of runs that failed, still run or aren't known don't count.
    """
    completed = runs.filter(F.col("status") == "completed").select("run_id")
    ok = ledger.filter(F.col("outcome") == "ok").join(completed, "run_id", "left_semi")
    return latest_hash(ok, "content_id", "content_hash", "processed_at")


def pending_content(content: DataFrame, ledger: DataFrame, runs: DataFrame, buckets: int = 64) -> DataFrame:
    """``content_id, content_hash`` of the items that a run must take now.

    A job whose derived table is the list of work: what completed runs handled is
    adopted, and of every partition of ids whose fingerprint differs the list is
    written anew. ``updated_at`` only decides which version of an item is
    current; ``status`` isn't read. Hashes are compared in lower case. Empty
    content gives no rows, an empty ledger leaves everything to do.
    """
    spark = content.sparkSession
    current = latest_hash(content.withColumnRenamed("id", "content_id"), "content_id", "content_hash", "updated_at")
    checkpoint_dir(spark)
    handled = handled_by_completed_runs(ledger, runs).checkpoint()
    known = handled.select(F.col("content_id").alias("__key"), F.col("content_hash").alias("__value"))
    same = (F.col("content_id") == F.col("__key")) & F.col("content_hash").eqNullSafe(F.col("__value"))
    job = IncrementalJob(spark, f"{checkpoint_dir(spark)}/work-{uuid.uuid4().hex}", "content_id", "content_hash", lambda df: df.join(known, same, "left_anti"), buckets=buckets)
    job.adopt(handled)
    job.run(current)
    rows = job.rows()
    return rows if rows is not None else current.limit(0)


@dataclass
class Staged:
    """What a run has written but not yet committed; ``prints`` are the fingerprints of the whole source."""

    version: int
    prints: DataFrame
    n_parts: int
    n_changed: int


class IncrementalJob:
    """Keeps a derived table up to date, partition by partition.

    ``state`` is a folder on shared storage: ``data`` holds the derived rows, one
    directory a partition, and ``prints/version=N`` the fingerprints after the
    N-th run. ``stage`` replaces the changed partitions of ``data`` with one
    dynamic partition overwrite; ``commit`` then writes the next version of the
    fingerprints, which counts once it is complete. A run that dies in between
    leaves the old fingerprints, so the next one derives the same partitions from
    their whole content again: nothing is skipped, nothing is there twice.

    ``derive`` maps the rows of whole partitions to derived rows. ``part`` is the
    partition of a source row, for example its period of arrival; by default one
    of ``buckets`` buckets of the key. Keys may repeat in a partition. A null
    partition is one of its own; rows with a null key are left out. One job at a
    time may write to a folder.
    """

    def __init__(self, spark: SparkSession, state: str, key: str, value: str, derive: Callable[[DataFrame], DataFrame], part: Column | None = None, buckets: int = 64) -> None:
        self.spark, self.state, self.key, self.value, self.derive = spark, state, key, value, derive
        self.part = (part if part is not None else bucket_of(key, buckets)).cast("string")

    def _paths(self, pattern: str) -> list[str]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.state}/{pattern}")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return [f.getPath().toString() for f in found or []]

    def version(self) -> int:
        """The number of the last committed run; 0 before the first."""
        return max((int(p.rsplit("/", 2)[-2].partition("=")[2]) for p in self._paths("prints/version=*/_SUCCESS")), default=0)

    def prints(self) -> DataFrame:
        """``part, n, sum_a, sum_b, made``: the committed fingerprints; made is the run that derived the partition."""
        n = self.version()
        return self.spark.read.parquet(f"{self.state}/prints/version={n}") if n else self.spark.createDataFrame([], _PRINTS)

    def _with_part(self, source: DataFrame) -> DataFrame:
        return source.filter(F.col(self.key).isNotNull()).withColumn(_PART, F.coalesce(self.part, F.lit("")))

    def stage(self, source: DataFrame) -> Staged:
        """Derives the changed partitions and replaces them; the source is evaluated once."""
        checkpoint_dir(self.spark)
        rows = self._with_part(source).checkpoint()
        now = fingerprints(rows, self.key, self.value, by=F.col(_PART)).withColumnRenamed("bucket", "part")
        version, old = self.version() + 1, self.prints()
        was = old.select("part", *(F.col(c).alias(f"old_{c}") for c in ("n", "sum_a", "sum_b", "made")))
        same = F.lit(True)
        for c in ("n", "sum_a", "sum_b"):
            same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
        prints = now.join(was, "part", "left").select("part", "n", "sum_a", "sum_b", F.when(same, F.col("old_made")).otherwise(version).cast("long").alias("made")).checkpoint()
        n_parts, n_changed = prints.agg(F.count(F.lit(1)), F.count_if(F.col("made") == version)).first()
        n_gone = old.join(prints, "part", "left_anti").count()
        if n_changed:
            within = rows.join(prints.filter(F.col("made") == version).select(F.col("part").alias(_PART)), _PART, "left_semi")
            derived = self.derive(within).withColumns({_MADE: F.lit(version).cast("long"), _DIR: F.col(_PART)})
            derived.hint("rebalance", _DIR).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_DIR).parquet(f"{self.state}/data")
        return Staged(version, prints, n_parts, n_changed + n_gone)

    def commit(self, staged: Staged) -> int:
        """Makes the staged run count; returns the number of changed partitions, vanished ones included."""
        if staged.n_changed:
            staged.prints.coalesce(1).write.mode("overwrite").parquet(f"{self.state}/prints/version={staged.version}")
        return staged.n_changed

    def run(self, source: DataFrame) -> int:
        """Brings the table up to date; returns the number of changed partitions."""
        return self.commit(self.stage(source))

    def adopt(self, done: DataFrame) -> None:
        """Takes rows as handled that were derived elsewhere: their fingerprints are committed, no data is written."""
        prints = fingerprints(self._with_part(done), self.key, self.value, by=F.col(_PART)).withColumnRenamed("bucket", "part")
        prints.withColumn("made", F.lit(0).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{self.state}/prints/version={self.version() + 1}")

    def rows(self) -> DataFrame | None:
        """The derived rows, or None before anything was derived.

        Directories of partitions that vanished, or that gave no rows when they
        were last derived, keep old rows; these are left out here.
        """
        if not self._paths(f"data/{_DIR}=*"):
            return None
        live = self.prints().select(F.col("part").alias(_PART), F.col("made").alias("__live"))
        data = self.spark.read.parquet(f"{self.state}/data").join(live, _PART)
        return data.filter(F.col(_MADE) >= F.col("__live")).drop(_PART, _MADE, _DIR, "__live")
