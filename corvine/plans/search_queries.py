"""Queries of the search operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions import text as tx
from corvine.functions import vector as vec
from corvine.operators import search
from corvine.plans import views as v
from corvine.sources.tables import table

ASKED = "memory lock in the ring buffer"


def _vectors(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "embeddings").select("vec_id", "embedding")


def _asked(spark: SparkSession, base: str, *ids: int) -> DataFrame:
    return _vectors(spark, base).filter(F.col("vec_id").isin(*ids)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _texts(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select("doc_id", "text")


def f_nearest_cosine(spark: SparkSession, base: str) -> DataFrame:
    found = search.nearest(_asked(spark, base, 3), _vectors(spark, base), "vec_id", "embedding", 10, least=0.1)
    return found.withColumn("score", F.round("score", 5))


def f_nearest_batch(spark: SparkSession, base: str) -> DataFrame:
    # five queries, as in its SQL; f_nearest_every_100th has the whole set
    found = search.nearest(_asked(spark, base, 1, 2, 3, 5, 8), _vectors(spark, base), "vec_id", "embedding", 5)
    return found.withColumn("score", F.round("score", 5))


def f_nearest_every_100th(spark: SparkSession, base: str) -> DataFrame:
    """The batch search over the whole query set: every row whose id is divisible by 100."""
    rows = _vectors(spark, base)
    asked = rows.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.nearest(asked, rows, "vec_id", "embedding", 5).withColumn("score", F.round("score", 5))


def f_nearest_l2(spark: SparkSession, base: str) -> DataFrame:
    found = search.nearest(_asked(spark, base, 3), _vectors(spark, base), "vec_id", "embedding", 10, "l2", 1.4, F.col("vec_id") != 3)
    return found.withColumn("score", F.round("score", 5))


def f_nearest_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Chunks of completed C files next to the first vector."""
    chunks = v.chunks(spark, base)
    doc = v.content(spark, base).filter("status = 'COMPLETED' AND lower(content_type) IN ('c_source', 'c_header')").select(F.col("id").alias("content_id"))
    rows = chunks.filter("size(embedding) = 64").join(doc, "content_id")
    q = chunks.filter("size(embedding) = 64").agg(F.min_by("embedding", "id").alias("q")).select(F.lit(0).alias("query_id"), "q")
    return search.nearest(q, rows, "id", "embedding", 10).withColumn("score", F.round("score", 5))


def f_terms(spark: SparkSession, base: str) -> DataFrame:
    tf, df, _ = search.term_statistics(_texts(spark, base), "doc_id", "text")
    return df.join(tf.groupBy("term").agg(F.sum("tf").alias("n")), "term")


def f_bm25(spark: SparkSession, base: str) -> DataFrame:
    scored = search.bm25(_texts(spark, base), "doc_id", "text", search.tokens_of(ASKED))
    return scored.withColumn("bm25", F.round("bm25", 6))


def f_hybrid(spark: SparkSession, base: str) -> DataFrame:
    """Documents stand beside the vectors of the same number; twice as many candidates as results."""
    q = _asked(spark, base, 3)
    near = search.nearest(q, _vectors(spark, base), "vec_id", "embedding", 40, least=0.1).select(F.col("vec_id").alias("doc_id"), "score")
    ranked = search.hybrid(near.join(_texts(spark, base), "doc_id"), "doc_id", "text", ASKED, 20)
    return ranked.select("rank", "doc_id", *(F.round(x, 5).alias(x) for x in ("similarity", "bm25", "combined", "confidence")))


def f_overlap(spark: SparkSession, base: str) -> DataFrame:
    q = spark.createDataFrame([(1, ASKED), (2, "naïve test")], "query_id int, q string")
    return search.token_overlap(q, v.symbols(spark, base).select("id", F.coalesce("signature", "name").alias("signature")), "id", "signature", 10).withColumn("score", F.round("score", 6))


def f_full_text(spark: SparkSession, base: str) -> DataFrame:
    return search.full_text(_texts(spark, base), "doc_id", "text", "locked windows", 20)


def f_rewrite(spark: SparkSession, base: str) -> DataFrame:
    names = v.symbols(spark, base).select("id", F.regexp_replace("name", "_", " ").alias("q"))
    return names.select("id", tx.with_synonyms(tx.rewrite(F.concat(F.lit("the init of  DEV "), "q"))).alias("query"))


def f_expansions(spark: SparkSession, base: str) -> DataFrame:
    """The variants of a question about each symbol; one word of it has expansions."""
    asked = v.symbols(spark, base).select("id", F.concat(F.lit("alloc of "), "name").alias("q"))
    return asked.select("id", F.size(tx.expansions("q")).alias("n"), F.element_at(tx.expansions("q"), 2).alias("second"))


def f_enriched(spark: SparkSession, base: str) -> DataFrame:
    """Questions with a word of code, made ready for search."""
    return v.symbols(spark, base).select("id", tx.enriched(F.concat(F.lit("Memory  ALLOC in "), "name", F.lit("()  mem!!"))).alias("q"))


def f_boost(spark: SparkSession, base: str) -> DataFrame:
    sym = v.symbols(spark, base)
    first = sym.agg(F.min("name").alias("n")).scalar()
    part = sym.select("id", "name", F.lit(0.4).alias("score"), F.split_part(F.lit("x_ring"), F.lit("_"), F.lit(2)).alias("q")).withColumn("first", first)
    return part.select("id", F.round(tx.exact_boost("score", "name", "q") + tx.exact_boost("score", "name", "first"), 6).alias("score"))


def f_scores(spark: SparkSession, base: str) -> DataFrame:
    """The score expressions over a grid taken from the event values."""
    e = table(spark, base, "events").select("event_id", (F.pmod("value", F.lit(1.0))).alias("s"), (F.pmod(F.col("value") * 7, F.lit(1.0))).alias("b"))
    s, b = F.col("s"), F.col("b")
    return e.select("event_id", F.round(vec.combined(s, b), 6).alias("combined"), F.round(vec.confidence(s, b), 6).alias("confidence"), F.round(vec.similarity_level(s), 6).alias("level"), vec.quality_word(vec.combined(s, b)).alias("word"))


def f_vector_expressions(spark: SparkSession, base: str) -> DataFrame:
    """Dot product, cosine, distance and length of every vector against the first."""
    first = _vectors(spark, base).agg(F.min_by("embedding", "vec_id").alias("q"))
    both = _vectors(spark, base).crossJoin(F.broadcast(first))  # one row
    r = lambda c: F.round(c, 5)
    return both.select("vec_id", r(vec.dot("embedding", "q")).alias("dot"), r(vec.cosine("embedding", "q")).alias("cosine"), r(vec.distance("embedding", "q")).alias("distance"), r(vec.similarity01("embedding", "q")).alias("similarity"), r(vec.norm(vec.normalised("embedding"))).alias("length"))


def f_keywords(spark: SparkSession, base: str) -> DataFrame:
    return v.symbols(spark, base).select("id", F.array_join(tx.keywords(F.concat(F.lit("The Lock of a "), "name")), "+").alias("words"))


def f_citations(spark: SparkSession, base: str) -> DataFrame:
    file = v.files(spark, base).select(F.col("id").alias("file_id"), "path", "sha")
    cited = v.symbols(spark, base).join(file, "file_id").filter("start_line IS NOT NULL AND end_line IS NOT NULL AND sha IS NOT NULL")
    text = cited.select("id", tx.citation("path", "start_line", "end_line", "sha").alias("citation"))
    p = text.withColumn("p", tx.parse_citation("citation"))
    return p.select("id", "citation", "p.start", "p.end")


def f_context_lines(spark: SparkSession, base: str) -> DataFrame:
    picked = _texts(spark, base).select("doc_id", F.size(tx.context_lines("text", F.lit(ASKED))).alias("n_lines"))
    return picked.filter("n_lines > 0")


def f_line_chunks(spark: SparkSession, base: str) -> DataFrame:
    chunks = search.line_chunks(v.content(spark, base), "id", "content", 500, 50)
    return chunks.groupBy("item").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("line_end").alias("n_lines"))


def f_hashed_embeddings(spark: SparkSession, base: str) -> DataFrame:
    docs = _texts(spark, base).filter("length(text) > 0")
    made = search.embed(docs, "doc_id", "text")
    return made.select("doc_id", F.size("embedding").alias("width"), F.round(vec.norm("embedding"), 6).alias("norm"))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__name__", "")[:2] == "f_"}

_NEAR = "SELECT q.vec_id AS query_id, v.vec_id, {score} AS c FROM embeddings v, embeddings q WHERE q.vec_id IN ({ids}) {more}"
_COS = "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_L2 = "list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_RANK = "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY c {how}, vec_id) AS rank, vec_id, round(c, 5) AS score FROM s QUALIFY rank <= {k}"
_WORDS = "w AS (SELECT doc_id, text, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}_]+'), lambda t: length(t) >= 2) AS words FROM {docs})"
_TERMS = sorted(set(["memory", "lock", "in", "the", "ring", "buffer"]))
_BM25 = """
t AS (SELECT doc_id, len(words) AS length, term, count(*) AS tf FROM (SELECT doc_id, words, unnest(words) AS term FROM w) WHERE term IN ({terms}) GROUP BY doc_id, words, term),
d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
z AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM w),
k AS (SELECT t.doc_id, sum(ln((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM t JOIN d USING (term), z GROUP BY t.doc_id),
b AS (SELECT w.doc_id, greatest(0, least(1, tanh(coalesce(score, 0) / 10))) AS bm25 FROM w LEFT JOIN k USING (doc_id))
""".replace("{terms}", ", ".join(f"'{t}'" for t in _TERMS))

SQL = {
    "f_nearest_cosine": "WITH s AS (" + _NEAR.format(score=_COS, ids="3", more=f"AND {_COS} >= 0.1") + ") " + _RANK.format(how="DESC", k=10),
    "f_nearest_batch": "WITH s AS (" + _NEAR.format(score=_COS, ids="1, 2, 3, 5, 8", more="") + ") " + _RANK.format(how="DESC", k=5),
    "f_nearest_every_100th": f"WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS c FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0) " + _RANK.format(how="DESC", k=5),
    "f_nearest_l2": "WITH s AS (" + _NEAR.format(score=_L2, ids="3", more=f"AND v.vec_id <> 3 AND {_L2} < 1.4") + ") " + _RANK.format(how="ASC", k=10),
    "f_nearest_chunks": v.with_(v.CHUNK, v.DOC) + """
, c AS (SELECT * FROM chunk WHERE len(embedding) = 64), q AS (SELECT embedding AS e FROM c ORDER BY id LIMIT 1),
s AS (SELECT c.id, CASE WHEN list_max(list_transform(c.embedding, lambda x: abs(x))) = 0 THEN 0 ELSE list_cosine_similarity(c.embedding::DOUBLE[], q.e::DOUBLE[]) END AS s FROM c JOIN doc ON doc.id = c.content_id, q WHERE doc.status = 'COMPLETED' AND lower(doc.content_type) IN ('c_source', 'c_header'))
SELECT 0 AS query_id, row_number() OVER (ORDER BY s DESC, id) AS rank, id, round(s, 5) AS score FROM s QUALIFY rank <= 10""",
    "f_terms": "WITH " + _WORDS.replace("{docs}", "documents") + " SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM (SELECT doc_id, unnest(words) AS term FROM w) GROUP BY term",
    "f_bm25": "WITH " + _WORDS.replace("{docs}", "documents") + "," + _BM25 + "SELECT doc_id, round(bm25, 6) AS bm25 FROM b",
    "f_hybrid": "WITH s AS (" + _NEAR.format(score=_COS, ids="3", more=f"AND {_COS} >= 0.1") + "), near AS (SELECT vec_id AS doc_id, c FROM s ORDER BY c DESC, vec_id LIMIT 40), cand AS (SELECT doc_id, text, c FROM near JOIN documents USING (doc_id)), "
    + _WORDS.replace("{docs}", "cand") + "," + _BM25 + """
, r AS (SELECT doc_id, c, bm25, 0.7 * c + 0.3 * bm25 AS m FROM b JOIN cand USING (doc_id))
SELECT row_number() OVER (ORDER BY m DESC, doc_id) AS rank, doc_id, round(c, 5) AS similarity, round(bm25, 5) AS bm25, round(m, 5) AS combined,
  round(greatest(0, least(1, m + 0.15 * least(c, bm25) + 0.1)), 5) AS confidence FROM r QUALIFY rank <= 20""",
    "f_overlap": v.with_(v.SYM) + """
, q(query_id, q) AS (VALUES (1, 'memory lock in the ring buffer'), (2, 'naïve test')),
qs AS (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(q), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS a FROM q),
ts AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(signature, name)), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS b FROM sym),
s AS (SELECT query_id, id, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS s FROM qs, ts WHERE len(list_intersect(a, b)) > 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank, id, round(s, 6) AS score FROM s QUALIFY rank <= 10""",
    "f_full_text": "WITH " + _WORDS.replace("{docs}", "documents") + """
SELECT doc_id, len(list_filter(words, lambda t: starts_with(t, 'lock'))) + len(list_filter(words, lambda t: starts_with(t, 'window'))) AS hits FROM w
WHERE len(list_filter(words, lambda t: starts_with(t, 'lock'))) > 0 AND len(list_filter(words, lambda t: starts_with(t, 'window'))) > 0 ORDER BY hits DESC, doc_id LIMIT 20""",
    "f_expansions": v.with_(v.SYM) + "SELECT id, CASE WHEN contains(name, '_') THEN 4 ELSE 3 END AS n, 'allocate of ' || lower(name) AS second FROM sym",
    "f_enriched": v.with_(v.SYM) + "SELECT id, 'memory heap stack alloc allocation allocate in ' || name || '() mem! memory heap stack' AS q FROM sym",
    "f_vector_expressions": f"""
WITH f AS (SELECT arg_min(embedding, vec_id)::DOUBLE[] AS q FROM embeddings), e AS (SELECT vec_id, embedding::DOUBLE[] AS e, q FROM embeddings, f)
SELECT vec_id, round(list_inner_product(e, q), 5) AS dot, round(list_cosine_similarity(e, q), 5) AS cosine, round(list_distance(e, q), 5) AS distance,
  round(greatest(0, least(1, (list_cosine_similarity(e, q) + 1) / 2)), 5) AS similarity, 1.0::DOUBLE AS length FROM e""",
    "f_keywords": v.with_(v.SYM) + "SELECT id, 'lock' || CASE WHEN length(name) > 2 THEN '+' || lower(name) ELSE '' END AS words FROM sym",
    "f_boost": v.with_(v.SYM) + """
, f AS (SELECT min(lower(name)) AS n0, min(name) AS n1 FROM sym)
SELECT id, round(0.4 * CASE WHEN contains(lower(name), 'ring') THEN 1.5 ELSE 1 END * CASE WHEN lower(name) = 'ring' THEN 2.25 ELSE 1 END
  + 0.4 * CASE WHEN contains(lower(name), lower(n1)) THEN 1.5 ELSE 1 END * CASE WHEN lower(name) = lower(n1) THEN 2.25 ELSE 1 END, 6)::DOUBLE AS score FROM sym, f""",
    "f_scores": """
WITH e AS (SELECT event_id, value % 1.0 AS s, (value * 7) % 1.0 AS b FROM events), m AS (SELECT *, 0.7 * s + (1 - 0.7::DOUBLE) * b AS m FROM e)
SELECT event_id, round(m, 6) AS combined, round(greatest(0, least(1, m + 0.15 * least(s, b) + 0.1)), 6) AS confidence,
  round(CASE WHEN s >= 0.9 THEN 0.95 WHEN s >= 0.8 THEN 0.85 WHEN s >= 0.7 THEN 0.75 WHEN s >= 0.6 THEN 0.65 WHEN s >= 0.5 THEN 0.55 ELSE greatest(0.1, 0.8 * s) END, 6)::DOUBLE AS level,
  CASE WHEN m >= 0.9 THEN 'excellent' WHEN m >= 0.7 THEN 'good' WHEN m >= 0.5 THEN 'moderate' ELSE 'weak' END AS word FROM m""",
    "f_citations": v.with_(v.SYM, v.FILE) + """
SELECT sym.id, path || ':' || CASE WHEN start_line = end_line THEN start_line::VARCHAR ELSE start_line || '-' || end_line END || '@' || substr(sha, 1, 8) AS citation, start_line AS start, end_line AS "end"
FROM sym JOIN file ON file.id = sym.file_id WHERE start_line IS NOT NULL AND end_line IS NOT NULL AND sha IS NOT NULL""",
    "f_hashed_embeddings": "SELECT doc_id, 64 AS width, CASE WHEN regexp_matches(lower(text), '[\\p{L}\\p{N}_]{2}') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents WHERE length(text) > 0",
}
