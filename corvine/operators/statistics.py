"""Statistics over large groups and small reports.

Aggregates are written so that Spark combines them before the shuffle. Null
group keys form a group of their own; empty tables give no groups, and global
statistics one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.functions.columns import CONFIDENCE_STATS, lookup


def call_statistics(edges: DataFrame, key: str, other: str) -> DataFrame:
    """Per ``key``: calls, distinct ``other``, direct, indirect and conditional calls."""
    return edges.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count_distinct(other).alias("n_others"),
        F.count_if(F.col("call_type") == "direct").alias("n_direct"),
        F.count_if(F.col("call_type") == "indirect").alias("n_indirect"),
        F.count_if(F.coalesce("conditional", F.lit(False))).alias("n_conditional"),
    )


def call_graph_totals(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: calls by kind, callers, callees, symbols without any call, mean confidence."""
    totals = edges.agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(F.col("call_type") == "direct").alias("n_direct"),
        F.count_if(F.col("call_type") == "indirect").alias("n_indirect"),
        F.count_if(F.coalesce("conditional", F.lit(False))).alias("n_conditional"),
        F.avg(lookup("confidence", CONFIDENCE_STATS)).alias("mean_confidence"),
    )
    ends = edges.select(F.explode(F.array("caller_id", "callee_id")).alias("id")).filter("id IS NOT NULL").distinct()
    alone = symbols.select("id").join(ends, "id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return totals.withColumn("n_symbols_without_calls", alone.scalar())


def latency_statistics(log: DataFrame, start: str, end: str) -> DataFrame:
    """Per query type in [start, end): count, mean, interpolated percentiles, distinct users."""
    within = log.filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    cont = lambda q: F.expr(f"percentile_cont({q}) WITHIN GROUP (ORDER BY latency_ms)")
    return within.groupBy("query_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("mean_ms"), cont(0.5).alias("p50_ms"), cont(0.95).alias("p95_ms"), cont(0.99).alias("p99_ms"), F.count_distinct("user").alias("n_users")
    )


def nearest_rank(df: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """``group, n, value`` with the element ``int(q n)`` of each group's sorted values, counted from 0.

    Works on counts of distinct values, so a hot group costs one row per
    distinct value, not one per record. Null values are left out.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(group)
    ranked = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(whole))
    at = F.least((F.col("n") * q).cast("long"), F.col("n") - 1)
    return ranked.filter((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(group, "n", value)


def status_report(rows: DataFrame, status: str, size: Column, count: str, updated: str) -> DataFrame:
    """Per status: rows, sum of ``count``, sum and mean of ``size``, last update."""
    return rows.groupBy(status).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(count), F.lit(0)).alias("n_parts"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_size"),
        F.coalesce(F.avg(size), F.lit(0.0)).alias("mean_size"),
        F.max(updated).alias("last_update"),
    )


def vector_statistics(vectors: DataFrame, vector: str, item: str, created: str) -> DataFrame:
    """One row: vectors, items, missing vectors, widths, time span, growth per day (at least one day)."""
    out = vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(item).alias("n_items"),
        F.count_if(F.col(vector).isNull()).alias("n_missing"),
        F.avg(F.size(vector).cast("double")).alias("mean_width"),
        F.count_distinct(F.size(vector)).alias("n_widths"),
        F.min(created).alias("first"),
        F.max(created).alias("last"),
    )
    days = F.greatest(F.floor((F.unix_timestamp("last") - F.unix_timestamp("first")) / 86400), F.lit(1))
    return out.withColumn("days", days).withColumn("growth_per_day", F.col("n") / days)


def worst_of(events: DataFrame, keys: DataFrame, key: str, level: str, order: list[str], none: str) -> DataFrame:
    """``key, worst``: the first level of ``order`` that a key has; ``none`` for keys without events."""
    rank = lookup(level, {x: i for i, x in enumerate(order)})
    worst = events.groupBy(key).agg(F.min(rank).alias("rank"))
    back = lookup("rank", dict(enumerate(order)), none)
    return keys.select(key).distinct().join(worst, key, "left").select(key, back.alias("worst"))


def level_counts(events: DataFrame, key: str, level: str) -> DataFrame:
    """``key, n, counts``: a map of counts per level; there are as many entries as levels."""
    per = events.filter(F.col(level).isNotNull()).groupBy(key, level).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(key).agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(level, "n")))).alias("counts"))


def merge_spans(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``keys, start, end, n``: spans of one key that overlap or touch (next line) become one.

    Spans without a start are dropped; an end before the start counts as the start.
    """
    clean = spans.filter(F.col(start).isNotNull()).select(*keys, F.col(start).alias("start"), F.greatest(F.col(start), F.coalesce(F.col(end), F.col(start))).alias("end"))
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = clean.withColumn("fresh", F.when(reach.isNull() | (F.col("start") > reach + 1), 1).otherwise(0))
    island = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("island")


def page(df: DataFrame, order: list, size: int, number: int) -> DataFrame:
    """A page of a total order; a page past the end is empty."""
    return df.orderBy(*order).offset(size * number).limit(size)
