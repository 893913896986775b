"""Structured Streaming: windowed statistics, change detection, queue processing.

Every job takes ``available_now=True`` to run to completion and stop; without it
the job keeps running on its trigger. State and offsets are in ``checkpoint``,
which all executors must share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _start(writer, available_now: bool, every: str) -> StreamingQuery:
    return writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime=every).start()


def windowed_statistics(stream: DataFrame, ts: str, group: str, value: str, width: str, lateness: str) -> DataFrame:
    """``start, <group>, n, mean``: per window and group; rows later than ``lateness`` are dropped."""
    rows = stream.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w"), group)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), group, "n", "mean")


def to_folder(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True, every: str = "30 seconds") -> StreamingQuery:
    """Appends finished rows to a parquet folder, exactly once."""
    return _start(stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append"), available_now, every)


def watch(spark: SparkSession, folder: str, schema: str, per_batch: int = 50) -> DataFrame:
    """New files of a folder as a stream, at most ``per_batch`` files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def last_event(batch: DataFrame, key: str, ts: str) -> DataFrame:
    """One row per key: the last event wins."""
    columns = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(ts, *[c for c in columns if c != ts])).alias("e")).select(key, *[F.col(f"e.{c}").alias(c) for c in columns])


def detect_changes(stream: DataFrame, key: str, value: str, ts: str, known: Callable[[], DataFrame], handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, every: str = "30 seconds") -> StreamingQuery:
    """Calls ``handle(changed, batch id)`` with the keys whose value differs from ``known()``.

    Deletions can't be seen in a folder; compare snapshots for these. After a
    failure a batch comes again under its number, so ``handle`` must be
    repeatable, for example by overwriting what the number wrote.
    """

    def each(batch: DataFrame, number: int) -> None:
        old = known().select(F.col(key).alias("__k"), F.col(value).alias("__v"))
        fresh = last_event(batch, key, ts)
        changed = fresh.join(old, (F.col(key) == F.col("__k")) & F.col(value).eqNullSafe(F.col("__v")), "left_anti")
        handle(changed, number)

    return _start(stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint), available_now, every)


def drain_queue(stream: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, available_now: bool = True, every: str = "5 seconds") -> StreamingQuery:
    """Processes pending rows in batches; each batch overwrites its own part of ``folder``, so repeats do no harm."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return _start(stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint), available_now, every)
