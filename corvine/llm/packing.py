"""Filling containers of fixed capacity.

Sum-of-squares packing: an item goes to the fill level that leaves the smallest
sum of squared counts of partially filled containers per level; the counts are
an array over the levels. Shards of bounded size are packed independently, and
the containers that stay partially filled are packed once more as items, over
sixteen shards at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.session import checkpoint_dir

SHARD = 20_000  # items of a shard, about
JOINED = 16  # shards whose partial containers are packed together
_MERGED = 1 << 62


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, numbered from 0 in order of opening.

    Sizes lie in 1..capacity. Ties go to the fullest level, then to the
    container that reached it last.
    """
    counts = np.zeros(capacity + 1, np.int64)
    at_level: list[list[int]] = [[] for _ in range(capacity + 1)]
    leaving = np.zeros(capacity + 1, np.int64)  # change when a container leaves the level
    leaving[1:] = np.iinfo(np.int32).max
    entering = np.ones(capacity + 1, np.int64)  # change when one enters it
    entering[capacity] = 0
    out = np.empty(len(sizes), np.int64)
    opened = 0
    for i, s in enumerate(sizes.tolist()):
        change = leaving[: capacity - s + 1] + entering[s:]
        h = capacity - s - int(change[::-1].argmin())
        if h:
            box = at_level[h].pop()
            counts[h] -= 1
            leaving[h] = 1 - 2 * counts[h] if counts[h] else np.iinfo(np.int32).max
            entering[h] = 2 * counts[h] + 1
        else:
            box, opened = opened, opened + 1
        to = h + s
        if to < capacity:
            at_level[to].append(box)
            counts[to] += 1
            leaving[to] = 1 - 2 * counts[to]
            entering[to] = 2 * counts[to] + 1
        out[i] = box
    return out


def _pieces(keys: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items larger than a container become full pieces and a rest."""
    times = np.maximum(1, -(-sizes // capacity))
    key = np.repeat(np.arange(len(keys)), times)
    piece = np.arange(len(key)) - np.repeat(np.cumsum(times) - times, times)
    start = piece * capacity
    return keys[key], piece, start, np.minimum(sizes[key] - start, capacity)


def pack(items: DataFrame, key: str, size: str, limits: dict[str, int], shard: int = SHARD) -> DataFrame:
    """``limit_name, capacity, container_id, <key>, piece, token_start, n_tokens``.

    One row per item and limit; an item larger than the capacity has one row per
    piece, no other is split. No container holds more than its capacity. Items
    of size 0 or null take no room: their container is null. Keys may repeat,
    each row is an item of its own. An empty table gives no rows. Other columns
    aren't read.
    """
    spark = items.sparkSession
    checkpoint_dir(spark)
    narrow = items.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    # rows are numbered and written once: repeated and null keys are spread over the shards like others
    narrow = narrow.withColumn("row", F.monotonically_increasing_id()).checkpoint()
    shards = max(1, math.ceil(narrow.count() / shard))
    table = F.array(*(F.struct(F.lit(n).alias("limit_name"), F.lit(int(c)).alias("capacity")) for n, c in limits.items()))
    spread = narrow.filter("size > 0").select(F.explode(table).alias("l"), "key", "size", "row").select("l.limit_name", "l.capacity", "key", "size", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(shards)).cast("int").alias("shard"))

    def first(ids: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, capacity, number = ids
        pdf = pdf.sort_values(["key", "size"], kind="stable")
        # a seeded order: neighbouring keys tend to have like sizes
        pdf = pdf.iloc[np.random.default_rng(int(number)).permutation(len(pdf))]
        keys, piece, start, length = _pieces(pdf["key"].to_numpy(), pdf["size"].to_numpy(), int(capacity))
        box = sum_of_squares(length, int(capacity))
        fill = np.bincount(box, length)[box].astype(np.int64)
        return pd.DataFrame({"limit_name": name, "capacity": capacity, "shard": number, "box": (np.int64(number) << 32) + box, "fill": fill, "key": keys, "piece": piece.astype(np.int32), "token_start": start, "n_tokens": length})

    schema = "limit_name string, capacity int, shard int, box long, fill long, key long, piece int, token_start long, n_tokens long"
    packed = spread.groupBy("limit_name", "capacity", "shard").applyInPandas(first, schema).checkpoint()

    def again(ids: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, capacity, number = ids
        pdf = pdf.sort_values("box")
        merged = sum_of_squares(pdf["fill"].to_numpy(), int(capacity))
        return pd.DataFrame({"limit_name": name, "box": pdf["box"].to_numpy(), "merged": _MERGED + (np.int64(number) << 32) + merged})

    if shards > 1:
        partial = packed.filter(F.col("fill") < F.col("capacity")).select("limit_name", "capacity", "box", "fill", F.floor(F.col("shard") / JOINED).cast("int").alias("shard")).distinct()
        renamed = partial.groupBy("limit_name", "capacity", "shard").applyInPandas(again, "limit_name string, box long, merged long")
        packed = packed.join(renamed, ["limit_name", "box"], "left").withColumn("box", F.coalesce("merged", "box"))
    placed = packed.select("limit_name", "capacity", F.col("box").alias("container_id"), F.col("key").alias(key), "piece", "token_start", "n_tokens")
    nothing = narrow.filter("size <= 0").select(F.explode(table).alias("l"), F.col("key").alias(key))
    nothing = nothing.select("l.limit_name", "l.capacity", F.lit(None).cast("long").alias("container_id"), key, F.lit(0).alias("piece"), F.lit(0).cast("long").alias("token_start"), F.lit(0).cast("long").alias("n_tokens"))
    return placed.unionByName(nothing)


def summary(packed: DataFrame) -> DataFrame:
    """``limit_name, capacity, n_containers, n_tokens, least_containers, fill``."""
    return (
        packed.groupBy("limit_name", "capacity")
        .agg(F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
        .withColumn("least_containers", F.ceil(F.col("n_tokens") / F.col("capacity")))
        .withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))
    )
