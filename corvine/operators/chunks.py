"""Graphs in chunks: numbering without a single task, size-bounded chunks, reassembly, compression, manifests.

Chunks are rows with arrays of nodes and edges; their sizes are bounded by the
limits, so a chunk fits into a task. Null ids are left out, repeated rows count
once, empty tables give no chunks.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from corvine.session import checkpoint_dir


def numbered(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """The rows with their place in the order, from 0.

    The rows are range-partitioned and sorted per partition; only the counts of
    the partitions are added up, so no task sees all rows.
    """
    checkpoint_dir(df.sparkSession)
    at = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__at", 33)
    counts = at.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a partition
    first, starts = 0, {}
    for r in sorted(counts):
        starts[r.part] = first
        first += r.n
    if not starts:
        return df.withColumn(name, F.lit(None).cast("long")).limit(0)
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv]), part)
    return at.withColumn(name, start + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")


def estimate(nodes: DataFrame, edges: DataFrame, max_nodes: int = 1_000, max_edges: int = 5_000) -> DataFrame:
    """One row ``n_nodes, n_edges, n_chunks``: the chunks that the limits need, at least one."""
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes")).withColumn("n_edges", edges.agg(F.count(F.lit(1)).alias("n")).scalar())
    return n.withColumn("n_chunks", F.greatest(F.ceil(F.col("n_nodes") / max_nodes), F.ceil(F.col("n_edges") / max_edges), F.lit(1)))


def by_size(nodes: DataFrame, max_nodes: int, order: list[str] | None = None) -> DataFrame:
    """``node, part``: nodes in chunks of ``max_nodes``, in the order of the columns.

    With the depth of a search before the node, neighbours tend to meet in a
    chunk; by default nodes are taken by their number.
    """
    placed = numbered(nodes.filter("node IS NOT NULL").distinct(), order or ["node"])
    return placed.select("node", F.floor(F.col("index") / max_nodes).alias("part"))


def build(parts: DataFrame, edges: DataFrame, attributes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks ``part, nodes, edges`` and the boundary edges ``src, dst, src_part, dst_part``.

    ``nodes`` is an array of (node, attributes as JSON), ``edges`` of the edges
    within the chunk. Edges to nodes without a part are dropped.
    """
    rows = parts if attributes is None else parts.join(attributes, "node", "left")
    extra = [] if attributes is None else [c for c in attributes.columns if c != "node"]
    node = F.struct("node", F.to_json(F.struct(*extra)).alias("attributes") if extra else F.lit("{}").alias("attributes"))
    nodes = rows.groupBy("part").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    ends = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    a = parts.select(F.col("node").alias("src"), F.col("part").alias("src_part"))
    b = parts.select(F.col("node").alias("dst"), F.col("part").alias("dst_part"))
    placed = ends.join(a, "src").join(b, "dst")
    inner = placed.filter("src_part = dst_part").groupBy(F.col("src_part").alias("part")).agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("edges"))
    none = F.array().cast("array<struct<src:bigint,dst:bigint>>")
    return nodes.join(inner, "part", "left").select("part", "nodes", F.coalesce("edges", none).alias("edges")), placed.filter("src_part <> dst_part")


def reassemble(chunks: DataFrame, boundary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, attributes`` and ``src, dst`` of chunks and boundary edges; the inverse of ``build``, attributes kept."""
    nodes = chunks.select(F.explode("nodes").alias("n")).select("n.node", "n.attributes").dropDuplicates(["node"])
    inner = chunks.select(F.explode("edges").alias("e")).select("e.src", "e.dst")
    return nodes, inner.unionByName(boundary.select("src", "dst")).distinct()


def stream(chunks: DataFrame) -> Iterator[Row]:
    """The chunks one after another in the order of their number; one partition at a time comes to the driver."""
    yield from chunks.repartitionByRange("part").sortWithinPartitions("part").toLocalIterator(prefetchPartitions=True)


@F.pandas_udf(BinaryType())
def gzipped(texts: pd.Series) -> pd.Series:
    """Texts as gzip, the same bytes for the same text; null stays null."""
    return texts.map(lambda t: None if t is None else gzip.compress(t.encode("utf-8", "surrogatepass"), mtime=0))


@F.pandas_udf(StringType())
def gunzipped(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else gzip.decompress(bytes(b)).decode("utf-8", "surrogatepass"))


def compressed(df: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, size_bytes, compressed_bytes, ratio, payload``: texts as base64 of gzip with their sizes; ratio null for empty texts."""
    rows = df.select(key, F.octet_length(text).cast("long").alias("size_bytes"), gzipped(text).alias("gz"))
    small = F.octet_length("gz").cast("long")
    return rows.select(key, "size_bytes", small.alias("compressed_bytes"), (small / F.nullif("size_bytes", F.lit(0))).alias("ratio"), F.base64("gz").alias("payload"))


def restored(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``<key>, text`` of base64 payloads."""
    return df.select(key, gunzipped(F.unbase64(payload)).alias("text"))


def stable_uuid(*columns: Column | str) -> Column:
    """A UUID (version 3 layout) from a hash of the columns: the same for the same values on every run."""
    h = F.md5(F.to_json(F.struct(*columns)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("3"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12))


def manifest_problems(manifest: DataFrame) -> DataFrame:
    """``problem, n`` of a manifest (``chunk_id, path, version, size_bytes, total_bytes, created``).

    Repeated ids and paths, versions that aren't three numbers, times that aren't
    RFC 3339, and a total that isn't the sum of the sizes.
    """
    twice = lambda c: manifest.groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("n"))
    checks = {
        "repeated id": twice("chunk_id"),
        "repeated path": twice("path"),
        "version": manifest.filter(~F.coalesce(F.col("version").rlike(r"^\d+\.\d+\.\d+$"), F.lit(False))).agg(F.count(F.lit(1)).alias("n")),
        "time": manifest.filter(~F.coalesce(F.col("created").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)$"), F.lit(False))).agg(F.count(F.lit(1)).alias("n")),
        "total": manifest.agg(F.coalesce((F.sum("size_bytes") != F.max("total_bytes")).cast("long"), F.lit(0)).alias("n")),
    }
    out = None
    for problem, df in checks.items():
        row = df.select(F.lit(problem).alias("problem"), F.col("n").cast("long").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out.filter("n > 0")


def updated_manifest(manifest: DataFrame, new: DataFrame, removed: DataFrame) -> DataFrame:
    """The manifest with ``new`` rows in place of those of the same id and without the ids of ``removed``; the total follows the sizes."""
    kept = manifest.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new).join(removed.select("chunk_id").distinct(), "chunk_id", "left_anti")
    total = kept.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("t"))
    return kept.drop("total_bytes").withColumn("total_bytes", total.scalar())


def export_statistics(chunks: DataFrame, group: str) -> DataFrame:
    """``<group>, statistics``: JSON with total_chunks, total_size_bytes, total_nodes, total_edges and avg_chunk_size, rounded half up."""
    return chunks.groupBy(group).agg(
        F.to_json(
            F.struct(
                F.count(F.lit(1)).alias("total_chunks"),
                F.sum("size_bytes").alias("total_size_bytes"),
                F.sum("n_nodes").alias("total_nodes"),
                F.sum("n_edges").alias("total_edges"),
                F.round(F.avg("size_bytes")).cast("long").alias("avg_chunk_size"),
            )
        ).alias("statistics")
    )

