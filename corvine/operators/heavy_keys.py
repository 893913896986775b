"""Per-key results when a handful of keys hold most rows.

The rows are range-partitioned on the composite (key, member, item); Spark
samples the quantiles of that composite, so a heavy key is simply cut over as
many partitions as its share asks for. Each sorted partition is folded into one
partial state per key, and states of one key in neighbouring partitions are
stitched: counts add up, and a member whose rows straddle a cut is counted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corvine.session import checkpoint_dir

_STATE = StructType(
    [
        StructField("part", LongType()),
        StructField("key", LongType()),
        StructField("n_items", LongType()),
        StructField("n_members", LongType()),
        StructField("first_member", LongType()),
        StructField("last_member", LongType()),
        StructField("last_us", LongType()),
    ]
)

_NONE = np.iinfo(np.int64).min


def _longs(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values with 0 for null, and the null flags."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), null


class _Fold:
    """Folds sorted batches into states, all groups of a batch at once; keeps only the open key between batches."""

    def __init__(self) -> None:
        self.last: tuple | None = None  # key, member and item of the last row, each with its null flag
        self.open: dict[str, np.ndarray] | None = None

    def add(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        """The states that ended in the batch."""
        columns = [_longs(batch.column(i)) for i in range(4)]
        (key, key_null), (member, member_null), (item, item_null), (ts, ts_null) = columns
        n = len(key)
        new_key, new_member, new_item = (np.ones(n, bool) for _ in range(3))
        same = (key[1:] == key[:-1]) & (key_null[1:] == key_null[:-1])
        new_key[1:] = ~same
        same &= (member[1:] == member[:-1]) & (member_null[1:] == member_null[:-1])
        new_member[1:] = ~same
        same &= (item[1:] == item[:-1]) & (item_null[1:] == item_null[:-1])
        new_item[1:] = ~same
        if self.last is not None:
            k, kn, m, mn, i, i_n = self.last
            new_key[0] = (key[0], key_null[0]) != (k, kn)
            new_member[0] = new_key[0] or (member[0], member_null[0]) != (m, mn)
            new_item[0] = new_member[0] or (item[0], item_null[0]) != (i, i_n)
        self.last = tuple(x[-1] for pair in columns[:3] for x in pair)

        starts = np.flatnonzero(new_key)
        at = np.concatenate([[0], starts[starts > 0]]).astype(np.int64)
        known = np.maximum.reduceat((~member_null).astype(np.int8), at).astype(bool)
        groups = {
            "key": key[at],
            "key_null": key_null[at],
            "items": np.add.reduceat(new_item.astype(np.int64), at),
            "members": np.add.reduceat((new_member & ~member_null).astype(np.int64), at),
            # nulls sort first, so a key's last member is known if any is
            "first": np.minimum.reduceat(np.where(member_null, np.iinfo(np.int64).max, member), at),
            "last": member[np.concatenate([at[1:], [n]]) - 1],
            "known": known,
            "us": np.maximum.reduceat(np.where(ts_null, _NONE, ts), at),
        }
        if self.open is not None:
            if new_key[0]:
                groups = {c: np.concatenate([self.open[c], g]) for c, g in groups.items()}
            else:
                self._join(groups)
        self.open = {c: g[-1:] for c, g in groups.items()}
        return {c: g[:-1] for c, g in groups.items()}

    def _join(self, groups: dict[str, np.ndarray]) -> None:
        """Puts the open state before the first group, which has the same key."""
        o = self.open
        for c in ("items", "members"):
            groups[c][0] += o[c][0]
        groups["us"][0] = max(groups["us"][0], o["us"][0])
        if o["known"][0]:
            groups["first"][0] = o["first"][0]
            if not groups["known"][0]:
                groups["last"][0] = o["last"][0]
            groups["known"][0] = True


def _fold_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def out(g: dict[str, np.ndarray]) -> pa.RecordBatch:
        none = ~g["known"]
        arrays = [
            pa.array(np.full(len(none), part, np.int64)),
            pa.array(g["key"], mask=g["key_null"]),
            pa.array(g["items"]),
            pa.array(g["members"]),
            pa.array(g["first"], mask=none),
            pa.array(g["last"], mask=none),
            pa.array(g["us"], mask=g["us"] == _NONE),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=_STATE.names)

    fold = _Fold()
    for batch in batches:
        if batch.num_rows and len((done := fold.add(batch))["key"]):
            yield out(done)
    if fold.open is not None:
        yield out(fold.open)


def partial_states(df: DataFrame, key: str, member: str, item: str, ts: str, partitions: int | None = None) -> DataFrame:
    """One state per (partition, key) of the range-partitioned rows.

    Only four narrow columns are shuffled. All columns but ``ts`` must be
    integers. Rows with a null key get states under the null key, so that shares
    of the whole can be computed.
    """
    narrow = df.select(F.col(key).cast("long").alias("key"), F.col(member).cast("long").alias("member"), F.col(item).cast("long").alias("item"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    order = ["key", "member", "item"]
    ranged = narrow.repartitionByRange(partitions, *order) if partitions else narrow.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order).mapInArrow(_fold_partition, _STATE)


def per_key_summary(df: DataFrame, key: str, member: str, item: str, ts: str, partitions: int | None = None) -> DataFrame:
    """Per key: distinct items, distinct members and the latest time.

    Result: ``key, n_items, n_members, last_ts``, one row per key and one for the
    null key if any row has it.

    An item counts once per (key, member) however often its row is repeated, so
    re-delivered rows and ties have no effect; a null item counts as one item of
    its member; a null member is no member; null times are ignored (all null:
    null). An empty table gives no rows. Other columns aren't read, whatever
    their names.
    """
    states = partial_states(df, key, member, item, ts, partitions)
    near = Window.partitionBy("key").orderBy("part")
    # states with no known member carry none; they can't straddle a cut
    stitched = states.withColumn("before", F.lag("last_member").over(near))
    return stitched.groupBy("key").agg(
        F.sum("n_items").alias("n_items"),
        (F.sum("n_members") - F.coalesce(F.count_if(F.col("before") == F.col("first_member")), F.lit(0))).alias("n_members"),
        F.timestamp_micros(F.max("last_us")).alias("last_ts"),
    )


def heavy_keys(summary: DataFrame, least_share: float) -> DataFrame:
    """The keys of a summary that hold at least ``least_share`` of all items; null is no key.

    The whole includes the items under the null key. An empty summary gives no rows.
    The summary is written once, one narrow row per key, as the total and the
    comparison both need it.
    """
    checkpoint_dir(summary.sparkSession)
    summary = summary.checkpoint()
    total = summary.agg(F.sum("n_items").alias("total")).scalar()
    return summary.filter(F.col("key").isNotNull() & (F.col("n_items") >= F.lit(least_share) * total))
