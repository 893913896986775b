"""Changing immutable tables: upserts, replacements, cascades, retention.

Each function returns the new content of a table. Repeated rows and ties are
resolved by the given order; empty inputs leave the base as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.sources.tables import latest_rows


def upsert(base: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key: the greatest version; of equal versions the new row."""
    both = base.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    name = "__key"
    keyed = both.withColumn(name, F.struct(*keys))
    return latest_rows(keyed, name, [F.col(version).desc_nulls_last(), F.col("__new").desc()]).drop(name, "__new")


def insert_missing(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rows whose keys the base doesn't have; keys repeated in ``new`` count once."""
    return base.unionByName(new.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti"))


def replace_groups(base: DataFrame, new: DataFrame, groups: list[str]) -> DataFrame:
    """Deletes all rows of the groups that ``new`` holds and puts its rows in their place."""
    return base.join(new.select(*groups).distinct(), groups, "left_anti").unionByName(new)


def replace_partitions(new: DataFrame, path: str, by: list[str]) -> None:
    """Writes ``new``, replacing only the partitions it holds."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def cascade(parents: DataFrame, gone: Column, children: DataFrame, parent: str, child: str) -> tuple[DataFrame, DataFrame]:
    """Parents without those of the condition, and children without orphans of them."""
    dead = parents.filter(gone).select(F.col(parent).alias(child)).distinct()
    return parents.filter(~F.coalesce(gone, F.lit(False))), children.join(dead, child, "left_anti")


def resolve_names(calls: DataFrame, symbols: DataFrame, name: str = "callee") -> DataFrame:
    """Calls with ``callee_id``: the smallest id of the name in any file; unresolved calls are dropped."""
    ids = symbols.filter(F.col("name").isNotNull()).groupBy(F.col("name").alias(name)).agg(F.min("id").alias("callee_id"))
    return calls.join(ids, name)


def expired(ts: Column, now: str, days: int) -> Column:
    """Older than ``days`` before ``now``; null times never expire."""
    return F.coalesce(ts < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)), F.lit(False))


def retention_report(log: DataFrame, ts: str, now: str, steps: dict[str, int]) -> DataFrame:
    """``step, n``: how many rows each step would touch."""
    counts = log.agg(*(F.count_if(expired(F.col(ts), now, d)).alias(s) for s, d in steps.items()))
    return counts.unpivot([], list(steps), "step", "n")


def anonymise(log: DataFrame, ts: str, now: str, days: int, columns: list[str]) -> DataFrame:
    """The columns of rows older than ``days`` become null."""
    old = expired(F.col(ts), now, days)
    return log.withColumns({c: F.when(~old, F.col(c)) for c in columns})


def cleanup(rows: DataFrame, ts: str, now: str, days: Column | int, keep: Column | None = None) -> DataFrame:
    """Rows that aren't expired or that ``keep`` saves; ``days`` may be a column."""
    days = days if isinstance(days, Column) else F.lit(days)
    old = F.coalesce(F.col(ts) < F.lit(now).cast("timestamp") - F.make_dt_interval(days), F.lit(False))
    return rows.filter(~old | (F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(False)))


def fill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``key, change``: created, modified or deleted between two snapshots (one row per key)."""
    a, b = before.select(key, F.col(value).alias("__a"), F.lit(True).alias("__old")), after.select(key, F.col(value).alias("__b"), F.lit(True).alias("__now"))
    change = F.when(F.col("__old").isNull(), "created").when(F.col("__now").isNull(), "deleted").when(~F.col("__a").eqNullSafe(F.col("__b")), "modified")
    return a.join(b, key, "full").select(key, change.alias("change")).filter("change IS NOT NULL")
