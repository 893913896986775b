"""Configuration files and unified diffs to rows, with built-in expressions and windows.

Inputs have a file key, a line number and the line (``file, n, line``); see
``lines_of``. Windows run within one file. Unknown lines give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _stripped(c: str):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """``file, n, line``: the lines of each text from 1, without line ends; null texts have none."""
    return df.select(F.col(key).alias("file"), F.posexplode(F.split(text, r"\r?\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


def config_options(lines: DataFrame) -> DataFrame:
    """``file, name, type, value`` of a .config file.

    y and n are tristate, m a module, quoted text a string without the quotes,
    0x a hex number (its text kept), digits an int; ``is not set`` has no value.
    The last line of a name counts.
    """
    off = F.regexp_extract("line", r"^#\s*(CONFIG_\w+) is not set\s*$", 1)
    name = F.when(off != "", off).otherwise(F.regexp_extract("line", r"^(CONFIG_\w+)=", 1))
    value = F.rtrim(F.regexp_extract("line", r"^CONFIG_\w+=(.*)$", 1))
    kind = (
        F.when(off != "", "not_set").when(value.isin("y", "n"), "tristate").when(value == "m", "module").when(value.rlike('^".*"$'), "string")
        .when(value.rlike("^0[xX][0-9a-fA-F]+$"), "hex").when(value.rlike(r"^-?\d+$"), "int").otherwise("string")
    )
    text = F.when(off != "", F.lit(None)).when(value.rlike('^".*"$'), F.regexp_replace(value, '^"|"$', "")).otherwise(value)
    found = lines.select("file", "n", name.alias("name"), kind.alias("type"), text.alias("value")).filter("name <> ''")
    return found.groupBy("file", "name").agg(F.max_by(F.struct("type", "value"), "n").alias("o")).select("file", "name", "o.type", "o.value")


def config_header(lines: DataFrame) -> DataFrame:
    """``file, arch, version`` from the comment at the top."""
    pattern = r"^#\s*Linux/(\w+)\s+(\d+\.\d+(?:\.\d+)?)"
    return lines.filter(F.col("line").rlike(pattern)).groupBy("file").agg(F.min_by(F.struct(F.regexp_extract("line", pattern, 1).alias("arch"), F.regexp_extract("line", pattern, 2).alias("version")), "n").alias("h")).select("file", "h.arch", "h.version")


def config_map(options: DataFrame) -> DataFrame:
    """``file, context``: a map from option to whether it is on (y or m)."""
    on = F.col("value").isin("y", "m")
    return options.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("name", F.coalesce(on, F.lit(False)).alias("on")))).alias("context"))


def kconfig_options(lines: DataFrame) -> DataFrame:
    """``file, name, type, default, depends, help`` of each config block of a Kconfig file.

    depends is an array of the parts joined by &&. Help runs until the next line
    that isn't indented deeper than its keyword.
    """
    order = Window.partitionBy("file").orderBy("n")
    head = F.regexp_extract("line", r"^(?:menu)?config\s+(\w+)", 1)
    other = F.col("line").rlike(r"^(?:menu|endmenu|choice|endchoice|comment|source|if|endif|mainmenu)\b")
    block = F.when(head != "", head).when(other, F.lit(""))
    marked = lines.withColumn("name", F.last(block, ignorenulls=True).over(order)).filter("name <> ''")
    indent = F.length(F.regexp_extract("line", r"^(\s*)", 1))
    word = F.regexp_extract("line", r"^\s+(\w+)", 1)
    ours = Window.partitionBy("file", "name").orderBy("n")
    help_at = F.when(word.isin("help"), indent)
    marked = marked.withColumn("help_indent", F.last(help_at, ignorenulls=True).over(ours.rowsBetween(Window.unboundedPreceding, -1)))
    # help ends for good at the first line that isn't deeper
    marked = marked.withColumn("left", F.max(F.when(F.col("help_indent").isNotNull() & (_stripped("line") != "") & (indent <= F.col("help_indent")), 1)).over(ours))
    marked = marked.withColumn("in_help", F.col("help_indent").isNotNull() & F.col("left").isNull())
    code = ~F.col("in_help")
    kind = F.when(code & word.isin("bool", "tristate", "string", "int", "hex", "def_bool", "def_tristate"), F.regexp_replace(word, "^def_", ""))
    default = F.when(code, F.nullif(F.regexp_extract("line", r"^\s+(?:default|def_bool|def_tristate)\s+(\S+)", 1), F.lit("")))
    depends = F.when(code, F.nullif(F.regexp_extract("line", r"^\s+depends on\s+(.+)$", 1), F.lit("")))
    text = F.when(F.col("in_help") & (_stripped("line") != ""), F.struct("n", _stripped("line").alias("t")))
    out = marked.groupBy("file", "name").agg(F.min_by(kind, F.when(kind.isNotNull(), F.col("n"))).alias("type"), F.min_by(default, F.when(default.isNotNull(), F.col("n"))).alias("default"), F.array_sort(F.collect_list(F.when(depends.isNotNull(), F.struct("n", depends.alias("d"))))).alias("d"), F.array_sort(F.collect_list(text)).alias("h"))
    parts = F.flatten(F.transform("d", lambda x: F.split(F.trim(x["d"]), r"\s*&&\s*")))
    return out.select("file", "name", "type", "default", parts.alias("depends"), F.array_join(F.transform("h", lambda x: x["t"]), "\n").alias("help"))


def diff_lines(lines: DataFrame) -> DataFrame:
    """``file, n, path, sign, new_line, text``: the changed and context lines of unified diffs.

    new_line counts in the new file; removed lines carry the place where they stood.
    """
    order = Window.partitionBy("file").orderBy("n")
    path = F.regexp_extract("line", r"^\+\+\+ (?:b/)?(\S+)", 1)
    hunk = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1)
    marked = lines.withColumn("path", F.last(F.nullif(path, F.lit("")), ignorenulls=True).over(order))
    marked = marked.withColumn("start", F.last(F.when(hunk != "", hunk.cast("int")), ignorenulls=True).over(order))
    marked = marked.withColumn("hunk", F.sum(F.when(hunk != "", 1).otherwise(0)).over(order))
    header = F.col("line").rlike(r"^(?:@@ |\+\+\+ |--- |diff |index )")
    body = marked.filter(~header & F.col("start").isNotNull() & F.col("line").rlike(r"^[ +\-]"))
    within = Window.partitionBy("file", "hunk").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sign = F.substring("line", 1, 1)
    before = F.coalesce(F.sum(F.when(sign != "-", 1).otherwise(0)).over(within), F.lit(0))
    return body.select("file", "n", "path", sign.alias("sign"), (F.col("start") + before).cast("int").alias("new_line"), F.expr("substring(line, 2)").alias("text"))


def changed_symbols(changes: DataFrame) -> DataFrame:
    """``file, path, symbol, kind, change``: functions, types, macros and options on changed lines.

    A name on added and removed lines of a file is modified.
    """
    rules = [("function", r"^[A-Za-z_][\w \t*]*?\b(\w+)\s*\([^;]*$"), ("struct", r"\b(?:struct|union|enum)\s+(\w+)\s*\{"), ("macro", r"^\s*#\s*define\s+(\w+)"), ("config", r"\b(CONFIG_\w+)")]
    found = F.array_compact(F.array(*(F.when(F.regexp_extract("text", p, 1) != "", F.struct(F.lit(k).alias("kind"), F.regexp_extract("text", p, 1).alias("symbol"))) for k, p in rules)))
    rows = changes.filter("sign <> ' '").select("file", "path", "sign", F.explode(found).alias("f")).select("file", "path", "sign", "f.kind", "f.symbol")
    sides = rows.groupBy("file", "path", "symbol", "kind").agg(F.count_if(F.col("sign") == "+").alias("plus"), F.count_if(F.col("sign") == "-").alias("minus"))
    change = F.when((F.col("plus") > 0) & (F.col("minus") > 0), "modified").when(F.col("plus") > 0, "added").otherwise("removed")
    return sides.select("file", "path", "symbol", "kind", change.alias("change"))
