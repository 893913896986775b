"""What a change reaches, and where code and its specification differ.

Set-level operators over symbols, calls and requirements. Scores, risk levels
and recommendation texts are left to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.operators import graph


def affected(edges: DataFrame, changed: DataFrame, max_distance: int = 5) -> DataFrame:
    """``node, distance``: who depends on a changed node (``node``), by the least number of calls; the changed themselves have 0."""
    return graph.levels(graph.reverse(edges), changed, max_distance).select("node", F.col("depth").alias("distance"))


def blast_radius(edges: DataFrame, changed: DataFrame, max_distance: int) -> DataFrame:
    """``distance, n``: the number of affected nodes per distance."""
    return affected(edges, changed, max_distance).groupBy("distance").agg(F.count(F.lit(1)).alias("n"))


def affected_files(reached: DataFrame, symbols: DataFrame) -> DataFrame:
    """``file_id, n_symbols, nearest``: files that hold affected symbols (``id, file_id``)."""
    joined = reached.join(symbols.select(F.col("id").alias("node"), "file_id"), "node")
    return joined.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_symbols"), F.min("distance").alias("nearest"))


def missing_symbols(expected: DataFrame, symbols: DataFrame) -> DataFrame:
    """Expected ``name`` that no symbol has; null names are dropped."""
    return expected.filter("name IS NOT NULL").join(symbols.select("name").distinct(), "name", "left_anti")


def unexpected_symbols(expected: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols whose ``name`` nobody expects."""
    return symbols.join(expected.select("name").distinct(), "name", "left_anti")


def normal_signature(c: Column | str) -> Column:
    """Blanks folded, none around signs, so that only the words and signs matter."""
    folded = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(folded, r"\s*([(),*])\s*", "$1"), r";$", "")


def signature_differences(expected: DataFrame, symbols: DataFrame, strict: bool = False) -> DataFrame:
    """``name, expected, actual``: same name, another ``signature``; strict compares the texts as they are.

    A symbol without a signature differs from every expected one; a requirement
    without a signature asks for nothing.
    """
    norm = (lambda c: F.col(c)) if strict else (lambda c: normal_signature(c))
    want = expected.filter("signature IS NOT NULL").select("name", F.col("signature").alias("expected"))
    pairs = want.join(symbols.select("name", F.col("signature").alias("actual")), "name")
    return pairs.filter(~norm("expected").eqNullSafe(norm("actual"))).distinct()


def signature_parts(c: Column | str) -> Column:
    """struct<returns, parameters>: the text before the name, and the parameters."""
    n = normal_signature(c)
    inside = F.regexp_extract(n, r"\((.*)\)", 1)
    return F.struct(F.trim(F.regexp_extract(n, r"^(.*?)\w+\(", 1)).alias("returns"), F.filter(F.split(inside, ","), lambda p: (p != "") & (p != "void")).alias("parameters"))


def call_differences(expected: DataFrame, edges: DataFrame) -> DataFrame:
    """``src, dst, difference``: calls that are expected but ``absent``, or ``extra`` calls of a caller that has expectations."""
    want, have = expected.select("src", "dst").distinct(), graph.ends(edges).join(expected.select("src").distinct(), "src", "left_semi")
    absent = want.join(have, ["src", "dst"], "left_anti").withColumn("difference", F.lit("absent"))
    return absent.unionByName(have.join(want, ["src", "dst"], "left_anti").withColumn("difference", F.lit("extra")))


def by_option(edges: DataFrame, guard: str = "config_guard") -> DataFrame:
    """``option, n_edges, n_callers``: what hangs on each configuration option."""
    rows = edges.filter(F.col(guard).isNotNull()).withColumn("option", F.regexp_replace(guard, "^!", ""))
    return rows.groupBy("option").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("caller_id").alias("n_callers"))


def patch_impact(changes: DataFrame, symbols: DataFrame, edges: DataFrame, max_distance: int = 5) -> DataFrame:
    """``name, node, distance``: what the changed symbols of a patch (``symbol``) reach, nearest change only.

    Names that no symbol has are dropped; a name with several ids stands for all of them.
    """
    named = symbols.select(F.col("id").alias("node"), "name")
    start = changes.select(F.col("symbol").alias("name")).distinct().join(named, "name")
    return affected(edges, start, max_distance).join(named, "node", "left").select("name", "node", "distance")


def unmet_options(required: DataFrame, options: DataFrame) -> DataFrame:
    """``name, option``: requirements whose option isn't on (``name, option`` against ``name, value``)."""
    on = options.filter(F.col("value").isin("y", "m")).select(F.col("name").alias("option")).distinct()
    return required.filter("option IS NOT NULL").join(on, "option", "left_anti").select("name", "option")


def interface_breaks(expected: DataFrame, symbols: DataFrame) -> DataFrame:
    """``name, problem``: interfaces that are ``missing`` or whose ``returns`` or ``parameters`` changed."""
    want = expected.filter("signature IS NOT NULL").select("name", signature_parts("signature").alias("want"))
    have = symbols.groupBy("name").agg(F.max("signature").alias("s")).select("name", signature_parts("s").alias("have"), F.lit(True).alias("there"))
    joined = want.join(have, "name", "left")
    problem = F.when(F.col("there").isNull(), "missing").when(~F.col("want.returns").eqNullSafe(F.col("have.returns")), "returns").when(~F.col("want.parameters").eqNullSafe(F.col("have.parameters")), "parameters")
    return joined.select("name", problem.alias("problem")).filter("problem IS NOT NULL").distinct()


def header_impact(changed: DataFrame, includes: DataFrame) -> DataFrame:
    """``symbol, path, includer``: the files that include a header (``symbol, path``) whose struct or macro changed.

    ``includes`` has ``file, header``; a header is meant by the end of its path,
    at a slash. Changes outside of headers reach nobody here.
    """
    headers = changed.filter(F.col("path").endswith(".h")).select("symbol", "path", F.element_at(F.split("path", "/"), -1).alias("base")).distinct()
    named = includes.select(F.col("file").alias("includer"), "header", F.element_at(F.split("header", "/"), -1).alias("base"))
    hit = headers.join(named, "base").filter((F.col("path") == F.col("header")) | F.col("path").endswith(F.concat(F.lit("/"), F.col("header"))))
    return hit.select("symbol", "path", "includer").distinct()


def critical_path(edges: DataFrame, changed, target, max_depth: int | None = None) -> DataFrame:
    """``pos, node``: a shortest chain of calls by which the target depends on a changed node, the target first."""
    return graph.shortest_path(edges, target, changed, max_depth)
