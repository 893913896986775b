"""Graph interchange: JSON, GraphML, DOT and CSV out; JSON and GraphML in; chunk manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators.chunks import numbered

# The default types of the JSON form.
NODE_TYPE, EDGE_TYPE = "Function", "Direct"


def xml_escaped(c: Column | str) -> Column:
    out = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``value``: a JSON object per node (``id, name, type``) and per edge (``source, target, type``)."""
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("record"), "id", "name", F.coalesce("type", F.lit(NODE_TYPE)).alias("type"))).alias("value"))
    e = edges.select(F.to_json(F.struct(F.lit("edge").alias("record"), "source", "target", F.coalesce("type", F.lit(EDGE_TYPE)).alias("type"))).alias("value"))
    return n.unionByName(e)


def read_json_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``value``; missing types get the defaults, edges without known ends are dropped."""
    row = lines.select(F.from_json("value", "record string, id long, name string, type string, source long, target long").alias("r")).select("r.*")
    nodes = row.filter("record = 'node' AND id IS NOT NULL").select("id", "name", F.coalesce("type", F.lit(NODE_TYPE)).alias("type"))
    edges = row.filter("record = 'edge'").select("source", "target", F.coalesce("type", F.lit(EDGE_TYPE)).alias("type"))
    known = nodes.select("id")
    edges = edges.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, edges


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, value``: the body of a GraphML document, nodes (0) before edges (1)."""
    n = nodes.select(F.lit(0).alias("part"), F.concat(F.lit('<node id="n'), "id", F.lit('"><data key="d0">'), xml_escaped("name"), F.lit('</data><data key="d1">'), xml_escaped(F.coalesce("type", F.lit(NODE_TYPE))), F.lit("</data></node>")).alias("value"))
    e = edges.select(F.lit(1).alias("part"), F.concat(F.lit('<edge source="n'), "source", F.lit('" target="n'), "target", F.lit('"><data key="d2">'), xml_escaped(F.coalesce("type", F.lit(EDGE_TYPE))), F.lit("</data></edge>")).alias("value"))
    return n.unionByName(e)


# Fixed format: what stands before and behind the body.
GRAPHML_HEAD = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="name" attr.type="string"/><key id="d1" for="node" attr.name="type" attr.type="string"/><key id="d2" for="edge" attr.name="type" attr.type="string"/><graph edgedefault="directed">'
GRAPHML_TAIL = "</graph></graphml>"


def graphml_documents(body: DataFrame) -> DataFrame:
    """``value``: a whole GraphML document per partition of ``graphml_lines``, nodes before edges; empty partitions give none.

    Written as text, each file is a document; ``read_graphml`` reads the folder.
    """
    import pandas as pd

    def wrap(batches):
        begun = False
        for batch in batches:
            if len(batch) and not begun:
                begun = True
                yield pd.DataFrame({"value": [GRAPHML_HEAD]})
            yield batch[["value"]]
        if begun:
            yield pd.DataFrame({"value": [GRAPHML_TAIL]})

    return body.sortWithinPartitions("part").mapInPandas(wrap, "value string")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of GraphML files, by Spark's own XML reader."""
    data = "data ARRAY<STRUCT<_VALUE: STRING, _key: STRING>>"
    value = lambda k: F.element_at(F.transform(F.filter("data", lambda d: d["_key"] == k), lambda d: d["_VALUE"]), 1)
    number = lambda c: F.regexp_replace(c, "^n", "").cast("long")
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id STRING, {data}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source STRING, _target STRING, {data}").load(path)
    first = lambda k: F.when(F.size(F.filter("data", lambda d: d["_key"] == k)) > 0, value(k))
    return nodes.select(number("_id").alias("id"), first("d0").alias("name"), first("d1").alias("type")), edges.select(number("_source").alias("source"), number("_target").alias("target"), first("d2").alias("type"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, value``: the statements of a DOT digraph."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    n = nodes.select(F.lit(0).alias("part"), F.concat(F.lit("  n"), "id", F.lit(" [label="), quoted("name"), F.lit("];")).alias("value"))
    e = edges.select(F.lit(1).alias("part"), F.concat(F.lit("  n"), "source", F.lit(" -> n"), "target", F.lit(";")).alias("value"))
    return n.unionByName(e)


def edge_list(edges: DataFrame) -> DataFrame:
    """``source, target, type, weight`` for a CSV writer; parallel edges add up."""
    return edges.groupBy("source", "target", F.coalesce("type", F.lit(EDGE_TYPE)).alias("type")).agg(F.count(F.lit(1)).alias("weight"))


def cut_by_size(rows: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """The rows with ``chunk``, numbered from 0 in each group: chunks of consecutive rows up to ``limit`` bytes.

    Greedy with a reset is no window function, so each group is cut in one
    streaming pass over its sorted sizes (only key, order and size travel); a row
    above the limit is a chunk of its own. ``order`` must be unique in a group.
    """
    import pandas as pd

    def cut(ids, pdf):
        chunk, used, out = 0, 0, []
        for s in pdf.sort_values("o")["s"]:
            if used and used + s > limit:
                chunk, used = chunk + 1, 0
            used += s
            out.append(chunk)
        return pd.DataFrame({"g": ids[0], "o": pdf.sort_values("o")["o"].to_numpy(), "chunk": out})

    narrow = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(size).cast("long").alias("s"))
    kinds = dict(narrow.dtypes)
    marks = narrow.groupBy("g").applyInPandas(cut, f"g {kinds['g']}, o {kinds['o']}, chunk int")
    return rows.join(marks, (F.col(group).eqNullSafe(F.col("g"))) & (F.col(order) == F.col("o"))).drop("g", "o")


def manifest(chunks: DataFrame, group: str, chunk: str, payload: str) -> DataFrame:
    """``chunk_id, sequence, size_bytes, checksum`` of chunk payloads, sorted; ids like ``drivers_001`` per group.

    Payloads are hashed and measured where they are read; only the narrow rows
    are numbered, over all groups at once, so a large group isn't one task. Rows
    without a group are left out.
    """
    narrow = chunks.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(chunk).alias("c"), F.octet_length(payload).cast("long").alias("size_bytes"), F.sha2(payload, 256).alias("checksum"))
    placed = numbered(narrow, ["g", "c"])
    first = placed.groupBy("g").agg(F.min("index").alias("first"))
    named = placed.join(first, "g").withColumn("sequence", (F.col("index") - F.col("first") + 1).cast("int"))
    return named.orderBy("g", "sequence").select(F.format_string("%s_%03d", F.regexp_replace("g", "/", "_"), "sequence").alias("chunk_id"), "sequence", "size_bytes", "checksum")


def verify(declared: DataFrame, present: DataFrame) -> DataFrame:
    """``chunk_id, problem``: missing files, wrong sizes and wrong checksums (both: ``chunk_id, size_bytes, checksum``)."""
    p = present.select("chunk_id", F.col("size_bytes").alias("has_size"), F.col("checksum").alias("has_sum"), F.lit(True).alias("there"))
    problem = F.when(F.col("there").isNull(), "missing").when(~F.col("size_bytes").eqNullSafe(F.col("has_size")), "size").when(~F.lower("checksum").eqNullSafe(F.lower("has_sum")), "checksum")
    return declared.join(p, "chunk_id", "left").withColumn("problem", problem).filter("problem IS NOT NULL").select("chunk_id", "problem")


def read_chunks(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good records, and ``path, text`` of broken ones, of JSON chunk files with one object each."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parsed = files.withColumn("r", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    good = parsed.filter("r IS NOT NULL AND r._corrupt IS NULL").select("r.*").drop("_corrupt")
    return good, parsed.filter("r IS NULL OR r._corrupt IS NOT NULL").select("path", F.col("value").alias("text"))


def file_checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, size_bytes, checksum`` of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("checksum"))


def source_tree(spark: SparkSession, path: str, largest: int | None = None) -> DataFrame:
    """``path, text, sha`` of the C sources and headers below a folder, without those above ``largest`` bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{c,h}").load(path)
    kept = files if largest is None else files.filter(F.col("length") <= largest)
    return kept.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"), F.sha1("content").alias("sha"))
