"""References to records that don't exist.

Keys are cut into ranges at sampled quantiles of references and parents
together, as many as the counted rows ask for, so a range holds about
``SLICE_ROWS`` of them at any size. A key that fills several quantiles becomes a
range of its own with as many slices; its parents are sent to every slice, its
references to one each. Slices are numbered without gaps and each number is a
partition of its own, so no two share a task by chance. Within a slice the
parents come first and become sorted arrays, and batches of references are then
probed by binary search while they stream by, so memory follows the parents of
one range, never the references.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

SLICE_ROWS = 200_000  # references and parents of a slice, about
SAMPLED_PER_RANGE = 2_000  # rows of the sample for each cut, about

_FAR = np.iinfo(np.int64).max
_NEAR = np.iinfo(np.int64).min

_MISS = StructType([StructField("ref_id", LongType()), StructField("ref_field", StringType()), StructField("orphan_kind", StringType()), StructField("ts_us", LongType())])


def key_ranges(keys: DataFrame, ranges: int, fraction: float) -> tuple[list[int], list[int]]:
    """Cut points and the number of slices of each range.

    ``keys`` has one column ``key``. Range r holds the keys k with
    cuts[r-1] <= k < cuts[r]. The sample only decides the layout, never the
    result; ``ranges`` bounds what comes to the driver.
    """
    sample = keys.sample(fraction, seed=7) if fraction < 1 else keys
    steps = [i / ranges for i in range(1, ranges)]
    found = sample.agg(F.percentile_approx("key", steps, max(10_000, 20 * ranges)).alias("q")).first().q if steps else None
    cuts: list[int] = []
    heavy: dict[int, int] = {}
    for q in found or []:
        if cuts and cuts[-1] == q:
            heavy[q] = heavy.get(q, 1) + 1
        else:
            cuts.append(q)
    every = sorted({*cuts, *(q + 1 for q in heavy)})
    return every, [1, *(heavy.get(c, 1) for c in every)]


def _probe(parents: tuple[np.ndarray, np.ndarray, np.ndarray], key: np.ndarray, t: np.ndarray) -> np.ndarray:
    """0 existing, 1 missing, 2 deleted, 3 late, for each reference.

    parents: ids, starts and the latest end so far within an id, sorted by (id, start).
    """
    ids, starts, ends = parents
    lo, hi = np.searchsorted(ids, key, "left"), np.searchsorted(ids, key, "right")
    a, b = lo.copy(), hi.copy()
    while (a < b).any():  # in each id's rows, the number of starts <= t
        mid = (a + b) >> 1
        up = (a < b) & (starts[np.minimum(mid, max(len(starts) - 1, 0))] <= t)
        a, b = np.where(up, mid + 1, a), np.where((a < b) & ~up, mid, b)
    began = a > lo
    alive = began & (ends[np.maximum(a - 1, 0)] > t) if len(ends) else began
    return np.where(alive, 0, np.where(hi == lo, 1, np.where(began, 2, 3)))


def _arrays(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted arrays of the parents; lifetimes that an earlier one covers are left out."""
    if not rows:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    ids, starts, ends = np.concatenate(rows, axis=1)
    order = np.lexsort((starts, ids))
    ids, starts, ends = ids[order], starts[order], ends[order]
    top = pd.Series(ends).groupby(ids).cummax().to_numpy()
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != ids[:-1]) | (top[1:] > top[:-1])
    return ids[keep], starts[keep], top[keep]


def _compact(rows: list[np.ndarray]) -> list[np.ndarray]:
    return [np.stack(_arrays(rows))]


_KINDS = np.array(["", "missing", "deleted", "late"], dtype=object)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at: int | None = None
    rows: list[np.ndarray] = []
    held = 0
    parents = None
    for batch in batches:
        place, kind, key, ref, field, t, end = (batch.column(i) for i in range(7))
        place, kind, key = (x.to_numpy(zero_copy_only=False) for x in (place, kind, key))
        t_null = t.is_null().to_numpy(zero_copy_only=False)
        t = t.fill_null(0).to_numpy(zero_copy_only=False)
        end = end.fill_null(_FAR).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] != kind[:-1])) + 1), len(place)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            here = int(place[a])
            if here != at:
                at, rows, held, parents = here, [], 0, None
            if kind[a] == 0:
                # a lifetime without a beginning never begins: the id is known, nothing more
                rows.append(np.stack([key[a:b], np.where(t_null[a:b], _FAR, t[a:b]), end[a:b]]))
                held += b - a
                if held > 1 << 20:  # repeated deliveries and covered lifetimes don't pile up
                    rows, held = _compact(rows), 0
                continue
            if parents is None:
                parents, rows = _arrays(rows), []
            kinds = _probe(parents, key[a:b], np.where(t_null[a:b], _NEAR, t[a:b]))
            miss = np.flatnonzero(kinds) + a
            if len(miss):
                take = pa.array(miss)
                yield pa.RecordBatch.from_arrays(
                    [ref.take(take), field.take(take), pa.array(_KINDS[kinds[miss - a]], pa.string()), pa.array(t[miss], pa.int64(), mask=t_null[miss])],
                    names=["ref_id", "ref_field", "orphan_kind", "ts_us"],
                )


def orphans(refs: DataFrame, ref_id: str, fields: list[str], ts: str, parents: DataFrame, parent_id: str, begin: str, end: str, ranges: int | None = None, fraction: float | None = None) -> DataFrame:
    """``ref_id, ref_field, orphan_kind, ts`` of the references without an existing parent.

    A parent row exists from ``begin`` (inclusive) until ``end`` (exclusive; null:
    still there); an id may have many rows. orphan_kind is ``missing`` if no row
    has the id, else ``deleted`` if some row began at or before the reference,
    else ``late``. Null keys are no references. A null ``ts`` comes before every
    beginning and a row with a null ``begin`` never begins, so both can only be
    ``missing`` or ``late``. Repeated rows count once. An empty parent table
    leaves every reference missing; empty references give no rows.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("ref_field"), F.col(f).cast("long").alias("key")) for f in fields)))
    wide = refs.select(F.col(ref_id).cast("long").alias("ref_id"), us(ts).alias("t"), pairs.alias("p"))
    right = wide.select(F.col("p.key").alias("key"), "ref_id", F.col("p.ref_field").alias("ref_field"), "t").filter(F.col("key").isNotNull())
    left = parents.select(F.col(parent_id).cast("long").alias("key"), us(begin).alias("t"), us(end).alias("end")).filter(F.col("key").isNotNull())

    # counts come from the footers of the files; they and the sample only decide the layout
    rows = refs.count() * len(fields) + parents.count()
    ranges = ranges or max(8, math.ceil(rows / SLICE_ROWS))
    # a sample for the cuts: straight from the scans, without the unpivot
    keys = [refs.select(F.col(f).cast("long").alias("key")) for f in fields] + [parents.select(F.col(parent_id).cast("long").alias("key"))]
    union = keys[0]
    for k in keys[1:]:
        union = union.unionAll(k)
    cuts, slices = key_ranges(union.filter(F.col("key").isNotNull()), ranges, fraction or min(1.0, SAMPLED_PER_RANGE * ranges / max(rows, 1)))
    bounds, width = np.array(cuts, np.int64), np.array(slices, np.int64)
    first = np.cumsum(width) - width  # the number of each range's first slice

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(np.int64), "right").astype(np.int32))

    at = lambda values: F.element_at(F.lit([int(x) for x in values]), F.col("rng") + 1)
    refs_placed = right.withColumn("rng", range_of("key")).select(
        (at(first) + F.pmod(F.xxhash64("ref_id"), at(width))).cast("int").alias("slice"),
        F.lit(1).alias("kind"),
        "key", "ref_id", "ref_field", "t",
        F.lit(None).cast("long").alias("end"),
    )
    parents_placed = left.withColumn("rng", range_of("key")).select(
        F.explode(F.sequence(at(first), (at(first) + at(width) - 1).cast("int"))).alias("slice"),
        F.lit(0).alias("kind"),
        "key", F.lit(None).cast("long").alias("ref_id"), F.lit(None).cast("string").alias("ref_field"), "t", "end",
    )
    placed = parents_placed.unionByName(refs_placed)
    misses = placed.repartitionById(int(width.sum()), "slice").sortWithinPartitions("slice", "kind").mapInArrow(_stream, _MISS)
    once = misses.dropDuplicates(["ref_id", "ref_field", "orphan_kind", "ts_us"])
    return once.select("ref_id", "ref_field", "orphan_kind", F.timestamp_micros("ts_us").alias("ts"))


def orphans_by_period(found: DataFrame, period: str = "month") -> DataFrame:
    """``ref_field, orphan_kind, period, n_refs``: counts per field, kind and period of the reference."""
    return found.groupBy("ref_field", "orphan_kind", F.date_trunc(period, "ts").alias("period")).agg(F.count(F.lit(1)).alias("n_refs"))
