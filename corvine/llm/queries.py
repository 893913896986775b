"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from corvine.llm import functions_docs, mixing, mojibake, packing, splitting, tokens, vectors
from corvine.session import checkpoint_dir
from corvine.sources.tables import latest_rows, table


MOST = 1_000  # rows of a small table; beyond it a query refuses


def _few(df: DataFrame) -> list[Row]:
    """All rows of a table that is small by its meaning."""
    rows = df.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rows")
    return rows


def _limits(spark: SparkSession, base: str) -> dict[str, tuple[int, int]]:
    return {r.limit_name: (r.max_size, r.overlap) for r in _few(table(spark, base, "size_limit"))}


def current_content(spark: SparkSession, base: str, *columns: str) -> DataFrame:
    """The current row of each id: the greatest updated_at; of equals the greatest hash."""
    return _current(table(spark, base, "indexed_content").select("id", "content", *columns, "updated_at", "content_hash"))


def _current(rows: DataFrame) -> DataFrame:
    return latest_rows(rows, "id", [F.col("updated_at").desc_nulls_last(), F.col("content_hash").desc_nulls_last()]).drop("updated_at", "content_hash")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    limit, overlap = _limits(spark, base)["content_split"]
    rows = table(spark, base, "indexed_content").select("id", "content", "updated_at", "content_hash")
    # versions within the limit take part in choosing the current one, but not with their text
    long = rows.withColumn("content", F.when(F.length("content") > limit, F.col("content")))
    return splitting.oversized(_current(long), "id", "content", limit, overlap)


def p2_pieces(spark: SparkSession, base: str) -> DataFrame:
    limit, overlap = _limits(spark, base)["content_split"]
    return splitting.split_items(current_content(spark, base), "id", "content", limit, overlap)


def _pairs(spark: SparkSession, base: str) -> DataFrame:
    kind = F.lower("content_type")
    # versions of other types take part in choosing the current one, but not with their text
    text = F.when(kind.isin("c_source", "c_header", "source_file"), F.col("content"))
    rows = table(spark, base, "indexed_content").select("id", "content_type", "source_path", text.alias("content"), "updated_at", "content_hash")
    current = latest_rows(rows, "id", [F.col("updated_at").desc_nulls_last(), F.col("content_hash").desc_nulls_last()])
    return functions_docs.pairs(current.filter(F.col("content").isNotNull()), "id", "source_path", "content_type", "content")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return _pairs(spark, base).filter("nth = 0").select("content_id", "func_name")


def p3_pairs(spark: SparkSession, base: str) -> DataFrame:
    return _pairs(spark, base)


WIDTH = 64
LEAST_COSINE = 0.95


def _usable(spark: SparkSession, base: str) -> DataFrame:
    return vectors.usable(table(spark, base, "vector_embedding"), "id", "content_id", "embedding", WIDTH)


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    pairs = vectors.similar_pairs(_usable(spark, base), WIDTH, LEAST_COSINE)
    return pairs.select(F.col("a").alias("vec_id_a"), F.col("b").alias("vec_id_b"))


def p6_classes(spark: SparkSession, base: str) -> DataFrame:
    """Every usable vector with its class of equal vectors and the number of other classes near it."""
    members, links = vectors.linked_classes(_usable(spark, base), WIDTH, LEAST_COSINE)
    sides = links.select(F.explode(F.array("x", "y")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    rows = members.select("cls", "rep", "key").distinct().join(sides, "cls", "left")
    return rows.select(F.col("key").alias("vec_id"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p6_links(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of representatives of classes that are near each other."""
    members, links = vectors.linked_classes(_usable(spark, base), WIDTH, LEAST_COSINE)
    rep = members.groupBy("cls").agg(F.first("rep").alias("rep"))
    named = links.join(rep.select(F.col("cls").alias("x"), F.col("rep").alias("a")), "x").join(rep.select(F.col("cls").alias("y"), F.col("rep").alias("b")), "y")
    return named.select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), F.round("cosine", 5).alias("cosine"))


def p6_neighbours(spark: SparkSession, base: str) -> DataFrame:
    """The ten most similar of every vector whose id is divisible by 100, among all."""
    base_vectors = _usable(spark, base)
    found = vectors.neighbours(base_vectors.filter(F.col("key") % 100 == 0), base_vectors, WIDTH)
    return found.select(F.col("key").alias("vec_id"), "rank", F.col("neighbour").alias("neighbour_id"), F.round("cosine", 5).alias("cosine"))


def _sizes(spark: SparkSession, base: str, *keep: str) -> DataFrame:
    return tokens.sizes(table(spark, base, "documents"), "doc_id", "text", *keep)


def p7_packed(spark: SparkSession, base: str) -> DataFrame:
    limits = {r.limit_name: r.max_size for r in _few(table(spark, base, "size_limit").filter("unit = 'token'"))}
    return packing.pack(_sizes(spark, base), "doc_id", "n_tokens", limits)


def p7_summary(spark: SparkSession, base: str) -> DataFrame:
    return packing.summary(p7_packed(spark, base))


# Domains of the sources; languages of the documents.
DOMAINS = {
    "kernel_docs": "reference", "man_pages": "reference", "release_notes": "reference", "kconfig_help": "reference", "wiki": "reference",
    "commit_log": "development", "bug_tracker": "development", "code_review": "development",
    "mailing_list": "discussion", "forum": "discussion",
}
LANGUAGES = ["en", "de", "fr", "es", "pt", "pl", "cs", "ru", "zh", "ja"]


def _mix(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    targets = {r.source: (r.target_share, r.max_repeats) for r in _few(table(spark, base, "mix_target"))}
    return mixing.mix(_sizes(spark, base, "source", "lang"), "doc_id", "source", "lang", "n_tokens", targets, DOMAINS, LANGUAGES)


def p8_mix(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base)[0]


def p8_shares(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base)[1]


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return mojibake.garbled(table(spark, base, "documents"), "doc_id", "text")[0]


def p9_restored(spark: SparkSession, base: str) -> DataFrame:
    return mojibake.restore(table(spark, base, "documents"), "doc_id", "text")


def _checks(*checks: tuple[str, DataFrame]) -> DataFrame:
    """``what, n``: how many rows each of the tables has."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n") for what, df in checks]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def p2_checks(spark: SparkSession, base: str) -> DataFrame:
    """What must hold of the pieces, as counts."""
    checkpoint_dir(spark)
    limit, overlap = _limits(spark, base)["content_split"]
    texts = current_content(spark, base)
    pieces = splitting.split_items(texts, "id", "content", limit, overlap).checkpoint()
    near = Window.partitionBy("content_id").orderBy("chunk_index")  # the pieces of one text
    steps = pieces.select("content_id", "chunk_index", "char_start", "char_end", F.lag("char_end").over(near).alias("before"), F.lag("chunk_index").over(near).alias("number"))
    whole = pieces.join(texts.withColumnRenamed("id", "content_id"), "content_id")
    last = pieces.groupBy("content_id").agg(F.max("char_end").alias("end")).join(texts.withColumnRenamed("id", "content_id"), "content_id")
    return _checks(
        ("texts", pieces.select("content_id").distinct()),
        ("pieces above the limit", pieces.filter(F.length("chunk_text") > limit)),
        ("pieces that aren't their part of the text", whole.filter(~F.col("chunk_text").eqNullSafe(F.expr("substring(content, char_start + 1, char_end - char_start)")))),
        ("first pieces not at the start", steps.filter("before IS NULL AND (char_start <> 0 OR chunk_index <> 0)")),
        ("gaps, overlaps above the limit or steps back", steps.filter((F.col("char_start") > F.col("before")) | (F.col("char_start") < F.col("before") - overlap) | (F.col("char_end") <= F.col("before")) | (F.col("chunk_index") != F.col("number") + 1))),
        ("texts not covered to the end", last.filter(F.col("end") != F.length("content"))),
    )


def p3_checks(spark: SparkSession, base: str) -> DataFrame:
    """What must hold of the pairs, as counts."""
    checkpoint_dir(spark)
    found = _pairs(spark, base).checkpoint()
    texts = current_content(spark, base).select(F.col("id").alias("content_id"), "content")
    return _checks(
        ("code that isn't in the text", found.join(texts, "content_id").filter(~F.contains("content", "code"))),
        ("signatures without the name", found.filter(~F.contains("signature", "func_name"))),
        ("descriptions of less than four words", found.filter(F.size(F.split(F.trim("description"), r"\s+")) < functions_docs.LEAST_WORDS).filter(~F.col("description").rlike(r"[\x{3040}-\x{9FFF}]"))),
        ("names counted twice", found.groupBy("content_id", "func_name", "nth").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")),
        ("pairs of no source file", found.join(texts, "content_id", "left_anti")),
    )


def p7_checks(spark: SparkSession, base: str) -> DataFrame:
    """What must hold of the containers, as counts."""
    checkpoint_dir(spark)
    packed = p7_packed(spark, base).checkpoint()
    boxes = packed.filter("container_id IS NOT NULL").groupBy("limit_name", "capacity", "container_id").agg(F.sum("n_tokens").alias("fill"))
    items = packed.groupBy("limit_name", "capacity", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"))
    sizes = items.groupBy("doc_id").agg(F.count_distinct("tokens").alias("n"))
    return _checks(
        ("items under all limits", items),
        ("containers above their capacity", boxes.filter("fill > capacity")),
        ("items split that fit", items.filter("pieces > 1 AND tokens <= capacity")),
        ("items with gaps between pieces", items.filter("end <> tokens")),
        ("items of different sizes under different limits", sizes.filter("n > 1")),
        # partially filled containers that stay are a number, not a share
        ("limits with 1 % and 40 containers more than the least", packing.summary(packed).filter("n_containers > 1.01 * least_containers + 40")),
    )


def p8_checks(spark: SparkSession, base: str) -> DataFrame:
    """What must hold of the mix, as counts."""
    checkpoint_dir(spark)
    chosen, report = _mix(spark, base)
    chosen = chosen.checkpoint()
    targets = table(spark, base, "mix_target")
    total, largest = report.agg(F.sum("used_tokens").alias("t")), chosen.agg(F.max("n_tokens").alias("m"))
    # records are whole: each language of a source may miss its budget by half of one
    slack = 0.02 * total.scalar() + (len(LANGUAGES) + 1) * largest.scalar() / 2
    return _checks(
        ("sources with a target", report.filter("target_share > 0")),
        ("records of no target", chosen.join(targets, "source", "left_anti")),
        ("records used too often", chosen.join(targets, "source").filter("copies > max_repeats OR copies < 1")),
        ("records chosen twice", chosen.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")),
        ("sources short of their share though they have more", report.filter((F.col("used_tokens") + slack < F.col("target_share") * total.scalar()) & F.expr("used_tokens < 0.98 * available_tokens * max_repeats"))),
    )


def p9_checks(spark: SparkSession, base: str) -> DataFrame:
    """What must hold of the garbled documents, as counts."""
    checkpoint_dir(spark)
    docs = table(spark, base, "documents")
    found = mojibake.garbled(docs, "doc_id", "text")[0].checkpoint()
    marks = r"[\x{FFFD}\x{80}-\x{84}\x{86}-\x{9F}]"
    outside = docs.select("doc_id", mojibake.strip_quoted("text").alias("t"))
    return _checks(
        ("documents with marks that nobody writes", outside.filter(F.col("t").rlike(marks)).join(found, "doc_id", "left_semi")),
        ("documents with marks that aren't found", outside.filter(F.col("t").rlike(marks)).join(found, "doc_id", "left_anti")),
        ("ASCII documents that are found", docs.filter(~F.col("text").rlike(r"[\x{80}-\x{10FFFF}]")).join(found, "doc_id", "left_semi")),
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p2_checks, p3_found, p3_pairs, p3_checks, p6_found, p6_classes, p6_links, p6_neighbours, p7_packed, p7_summary, p7_checks, p8_mix, p8_shares, p8_checks, p9_found, p9_restored, p9_checks)}

_USABLE = f"""
WITH v AS (SELECT DISTINCT id, content_id, embedding::DOUBLE[] AS e FROM vector_embedding
           WHERE len(embedding) = {WIDTH} AND list_max(list_transform(embedding, lambda x: abs(x))) > 0)
"""

_CLASSES = _USABLE + f""",
r AS (SELECT e, min(id) AS rep FROM v GROUP BY e),
l AS (SELECT a.rep AS class_a, b.rep AS class_b, list_cosine_similarity(a.e, b.e) AS cosine FROM r a JOIN r b ON a.rep < b.rep WHERE list_cosine_similarity(a.e, b.e) >= {LEAST_COSINE})
"""

def _none(*what: str) -> str:
    return " UNION ALL SELECT unnest([{}]), 0".format(", ".join("'" + w.replace("'", "''") + "'" for w in what))


SQL = {
    "p2_checks": "WITH cur AS (SELECT id, arg_max(content, (updated_at, content_hash)) AS content FROM indexed_content GROUP BY id) SELECT 'texts' AS what, count(*) AS n FROM cur WHERE length(content) > 0"
    + _none("pieces above the limit", "pieces that aren't their part of the text", "first pieces not at the start", "gaps, overlaps above the limit or steps back", "texts not covered to the end"),
    "p3_checks": "SELECT 'code that isn''t in the text' AS what, 0 AS n" + _none("signatures without the name", "descriptions of less than four words", "names counted twice", "pairs of no source file"),
    "p7_checks": "SELECT 'items under all limits' AS what, count(*) * (SELECT count(*) FROM size_limit WHERE unit = 'token') AS n FROM documents"
    + _none("containers above their capacity", "items split that fit", "items with gaps between pieces", "items of different sizes under different limits", "limits with 1 % and 40 containers more than the least"),
    "p8_checks": "SELECT 'sources with a target' AS what, count(*) AS n FROM mix_target WHERE target_share > 0"
    + _none("records of no target", "records used too often", "records chosen twice", "sources short of their share though they have more"),
    "p9_checks": "SELECT 'documents with marks that nobody writes' AS what, count(*) AS n FROM documents WHERE regexp_matches(regexp_replace(text, '``[^`]*``|`[^`\\n]*`', ' ', 'g'), '[\\x{FFFD}\\x{80}-\\x{84}\\x{86}-\\x{9F}]')"
    + _none("documents with marks that aren't found", "ASCII documents that are found"),
    "p2_found": """
WITH cur AS (SELECT id, arg_max(content, updated_at) AS content FROM indexed_content GROUP BY id),
big AS (SELECT id, content, string_split(content, chr(10)) AS lines FROM cur
        WHERE length(content) > (SELECT max_size FROM size_limit WHERE limit_name = 'content_split')),
seen AS (
  SELECT id,
    list_max(list_transform(list_zip(lines, range(len(lines))), lambda p:
      length(p[1]) - CASE WHEN p[2] + 1 < len(lines) AND ends_with(p[1], chr(13)) THEN 1 ELSE 0 END)) AS line,
    list_max(list_transform(regexp_split_to_array(content, '[ \\t\\r\\n]+'), lambda w: length(w))) AS word
  FROM big)
SELECT id AS content_id, CASE WHEN line <= max_size THEN 'line' WHEN word <= max_size THEN 'word' ELSE 'none' END AS cut_kind FROM seen, size_limit WHERE limit_name = 'content_split'""",
    "p6_found": _USABLE + f"""
SELECT DISTINCT least(a.id, b.id) AS vec_id_a, greatest(a.id, b.id) AS vec_id_b
FROM v a JOIN v b ON a.id < b.id AND a.content_id <> b.content_id
WHERE list_cosine_similarity(a.e, b.e) >= {LEAST_COSINE}""",
    "p6_classes": _CLASSES + """,
n AS (SELECT c, count(*) AS n FROM (SELECT class_a AS c FROM l UNION ALL SELECT class_b FROM l) GROUP BY c)
SELECT DISTINCT v.id AS vec_id, r.rep AS class_id, coalesce(n.n, 0) AS n_links FROM v JOIN r ON r.e = v.e LEFT JOIN n ON n.c = r.rep""",
    "p6_links": _CLASSES + "SELECT class_a, class_b, round(cosine, 5) AS cosine FROM l",
    "p6_neighbours": _USABLE + """,
s AS (SELECT a.id AS vec_id, b.id AS neighbour_id, max(list_cosine_similarity(a.e, b.e)) AS c
      FROM v a JOIN v b ON a.content_id <> b.content_id WHERE a.id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, neighbour_id) AS rank FROM s)
SELECT vec_id, rank, neighbour_id, round(c, 5) AS cosine FROM r WHERE rank <= 10""",
}
