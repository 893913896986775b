"""Table access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``base``; filters and columns reach the scan."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def latest_rows(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per non-null ``key``: the first in ``order``.

    Written as ``row_number() = 1`` because Spark then drops all but the best
    row of each key already before the shuffle (WindowGroupLimit), so a key
    that holds a third of all rows sends one row per map task.
    """
    rank = "__rank_of_row"
    best = Window.partitionBy(key).orderBy(*order)
    return df.filter(F.col(key).isNotNull()).withColumn(rank, F.row_number().over(best)).filter(F.col(rank) == 1).drop(rank)
