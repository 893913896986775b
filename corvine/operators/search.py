"""Search: nearest vectors, keyword scores, hybrid ranking, chunking.

Queries are small tables (``query_id`` and what is asked for); the corpus is
only scanned. Ties are broken by id so that results are stable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvine.functions import text as tx
from corvine.functions import vector as vec
from corvine.session import checkpoint_dir

QUERIES_AT_ONCE = 1_000


def small_side(queries: DataFrame, most: int = QUERIES_AT_ONCE) -> DataFrame:
    """Refuses a query table that is too large to be sent to every task."""
    if queries.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} queries at once")
    return F.broadcast(queries)


def nearest(queries: DataFrame, corpus: DataFrame, item: str, vector: str, k: int, metric: str = "cosine", least: float | None = None, where: Column | None = None) -> DataFrame:
    """``query_id, rank, <item>, score``: exact search of the query vectors (``query_id, q``) in the corpus.

    Cosine: highest first, at least ``least``; l2: the distance, lowest first, below
    ``least``. Vectors that are null, hold nulls or are of another width take no
    part; a zero vector has the cosine 0. The queries pass through the driver and
    travel with the tasks in blocks of ``QUERIES_AT_ONCE``, each with its own scan;
    each batch of vectors is one matrix product that keeps k candidates a query, so
    little is shuffled.
    """
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).filter("q IS NOT NULL")
    by_width: dict[int, list[tuple[list, list]]] = {}
    for r in asked.toLocalIterator():
        blocks = by_width.setdefault(len(r.q), [])
        if not blocks or len(blocks[-1][0]) == QUERIES_AT_ONCE:
            blocks.append(([], []))
        blocks[-1][0].append(r.query_id)
        blocks[-1][1].append(np.array(r.q, np.float64))
    rows = corpus.filter(where) if where is not None else corpus
    kinds, query_kind = dict(rows.dtypes), dict(queries.dtypes)["query_id"]
    id_type = to_arrow_type(queries.schema["query_id"].dataType)
    schema = f"query_id {query_kind}, `{item}` {kinds[item]}, score double"
    rows = rows.select(item, F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    # for cosine larger is better; for a distance its negative
    sign = 1.0 if metric == "cosine" else -1.0

    def part(width: int, ids: list, q: np.ndarray) -> DataFrame:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(1).flatten().to_numpy().reshape(-1, width)
                if not len(x):
                    continue
                if metric == "cosine":
                    size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
                    score = np.divide(q @ x.T, size, out=np.zeros(size.shape), where=size > 0)
                else:
                    score = np.sqrt(np.stack([((x - one) ** 2).sum(1) for one in q]))
                good = sign * score
                for i, name in enumerate(ids):
                    if len(x) > k:  # everything as good as the k-th stays, so ties are settled by id later
                        keep = np.flatnonzero(good[i] >= np.partition(good[i], -k)[-k] - 1e-12)
                    else:
                        keep = np.arange(len(x))
                    if least is not None:
                        keep = keep[score[i][keep] >= least] if metric == "cosine" else keep[score[i][keep] < least]
                    if len(keep):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(keep), id_type), b.column(0).take(pa.array(keep)), pa.array(score[i][keep])], names=["query_id", item, "score"])

        return rows.filter(F.size("v") == width).mapInArrow(run, schema)

    if not by_width:
        return rows.select(F.lit(None).cast(query_kind).alias("query_id"), F.lit(0).alias("rank"), item, F.lit(0.0).alias("score")).limit(0)
    found = [part(width, ids, np.stack(q)) for width, blocks in by_width.items() for ids, q in blocks]
    scored = found[0]
    for other in found[1:]:
        scored = scored.unionByName(other)
    first = F.col("score").desc() if metric == "cosine" else F.col("score").asc()
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(first, item)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", item, "score")


def term_statistics(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, term, tf), (term, df), one row (n, mean_length)."""
    words = docs.select(key, tx.tokens(text).alias("words"))
    tf = words.select(key, F.explode("words").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words").cast("double")).alias("mean_length"))
    return tf, df, size


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``key, bm25`` in 0..1 for every document: tanh of a tenth of the score, cut at 0.

    The corpus is the given documents. The inverse frequency has no added one, so
    terms in more than half of the documents count against; a term asked for
    twice counts twice. Null and empty texts score 0.
    """
    asked = docs.sparkSession.createDataFrame([(t, terms.count(t)) for t in dict.fromkeys(terms)], "term string, times int")
    words = docs.select(key, F.coalesce(tx.tokens(text), F.array().cast("array<string>")).alias("words"))
    # the texts are read once; what stays of a document is its length and the words asked for
    checkpoint_dir(docs.sparkSession)
    short = words.select(key, F.size("words").alias("length"), F.filter("words", lambda w: w.isin(terms)).alias("hits")).checkpoint()
    size = short.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("length").cast("double")).alias("mean_length"))
    hits = short.select(key, "length", F.explode("hits").alias("term")).groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, mean = size.select("n").scalar(), size.select("mean_length").scalar()
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(asked), "term").withColumn("n", n).withColumn("mean_length", mean)
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    total = scored.groupBy(key).agg(F.sum(part).alias("score"))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.tanh(F.coalesce("score", F.lit(0.0)) / 10)))
    return short.select(key).join(total, key, "left").select(key, bounded.alias("bm25"))


def hybrid(candidates: DataFrame, key: str, text: str, query: str, k: int, similarity: str = "score") -> DataFrame:
    """``rank, key, similarity, bm25, combined, confidence``: candidates of a vector search ranked with keywords.

    The candidates are the corpus of the keyword score; they are few and used
    several times, so they are written once.
    """
    checkpoint_dir(candidates.sparkSession)
    candidates = candidates.checkpoint()
    terms = tokens_of(query)
    scored = candidates.select(key, text, F.col(similarity).alias("similarity")).join(bm25(candidates, key, text, terms), key)
    both = vec.combined(F.col("similarity"), F.col("bm25"))
    sure = vec.confidence(F.col("similarity"), F.col("bm25"))
    out = scored.select(key, "similarity", "bm25", both.alias("combined"), sure.alias("confidence"))
    top = out.orderBy(F.col("combined").desc(), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("combined").desc(), key)))


def tokens_of(query: str) -> list[str]:
    """The same words as ``functions.text.tokens``, of one query on the driver."""
    import re

    return [w for w in re.findall(r"\w+", query.lower()) if len(w) >= 2]


def token_overlap(queries: DataFrame, corpus: DataFrame, item: str, text: str, k: int) -> DataFrame:
    """``query_id, rank, item, score``: shared part of the words of text and query (``query_id, q``)."""
    asked = small_side(queries.select("query_id", tx.token_set("q").alias("qs")))
    words = corpus.select(item, tx.token_set(F.coalesce(text, F.lit(""))).alias("ts"))
    # every text meets every query, of which there are at most QUERIES_AT_ONCE; only pairs that share a word stay
    hit = words.join(asked, F.arrays_overlap("ts", "qs")).select("query_id", item, tx.jaccard(F.col("ts"), F.col("qs")).alias("score"))
    ranked = hit.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), item)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", item, "score")


def stem(word: str) -> str:
    """A light English stemmer: plurals, -ed, -ing, -ly."""
    for end, put in (("sses", "ss"), ("ies", "y"), ("ing", ""), ("edly", ""), ("ed", ""), ("ly", ""), ("s", "")):
        if word.endswith(end) and len(word) - len(end) >= 3 and not (end == "s" and word.endswith("ss")):
            word = word[: len(word) - len(end)] + put
            if end in ("ing", "ed") and len(word) > 3 and word[-1] == word[-2] and word[-1] not in "lsz":
                word = word[:-1]
            return word
    return word


def full_text(docs: DataFrame, key: str, text: str, query: str, k: int) -> DataFrame:
    """``key, hits``: documents that hold the stem of every word asked for, by number of hits.

    Words are matched by prefix of the stem, so that no document is sent through Python.
    """
    stems = sorted({stem(w) for w in tokens_of(query) if w not in tx.STOP_WORDS})
    if not stems:
        return docs.select(key, F.lit(0).alias("hits")).limit(0)
    words = tx.tokens(text)

    def count(prefix: str) -> Column:
        return F.size(F.filter("words", lambda w: w.startswith(prefix)))

    counts = [count(s) for s in stems]
    found = docs.select(key, words.alias("words")).select(key, *[n.alias(f"n{i}") for i, n in enumerate(counts)])
    every = F.lit(True)
    total = F.lit(0)
    for i in range(len(stems)):
        every, total = every & (F.col(f"n{i}") > 0), total + F.col(f"n{i}")
    return found.filter(every).select(key, total.alias("hits")).orderBy(F.col("hits").desc(), key).limit(k)


_CHUNKS = "item long, chunk_index int, line_start int, line_end int, chunk_text string"


def line_chunks(docs: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """``item, chunk_index, line_start, line_end, chunk_text``: whole lines up to ``size`` characters.

    A chunk starts with the last lines of the one before that fit into
    ``overlap`` characters. A line longer than ``size`` is a chunk of its own.
    Null and empty texts give no chunks.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"]):
                if not t:
                    continue
                lines, start, used, number = t.split("\n"), 0, 0, 0
                for i, line in enumerate(lines):
                    cost = len(line) + 1
                    if used and used + cost > size:
                        rows.append((k, number, start + 1, i, "\n".join(lines[start:i])))
                        number += 1
                        keep, back = 0, i
                        while back > start + 1 and keep + len(lines[back - 1]) + 1 <= overlap and keep + len(lines[back - 1]) + 1 + cost <= size:
                            back -= 1
                            keep += len(lines[back]) + 1
                        start, used = back, keep
                    used += cost
                rows.append((k, number, start + 1, len(lines), "\n".join(lines[start:])))
            yield pd.DataFrame(rows, columns=["item", "chunk_index", "line_start", "line_end", "chunk_text"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter("k IS NOT NULL").mapInPandas(cut, _CHUNKS)


def index_parameters(n: Column) -> Column:
    """struct<m, ef_construction>: graph index parameters by the number of vectors."""
    size = lambda *v: F.when(n < 1_000, v[0]).when(n < 10_000, v[1]).when(n < 100_000, v[2]).otherwise(v[3])
    return F.struct(size(8, 16, 24, 32).alias("m"), size(32, 64, 128, 200).alias("ef_construction"))


def embed(docs: DataFrame, key: str, text: str, model=None, width: int = 64) -> DataFrame:
    """``key, embedding``: unit vectors; ``model`` maps a list of texts to vectors, hashing is used without one."""
    if model is None:
        # each word adds +1 or -1 at a place drawn from its hash
        words = docs.select(key, F.explode_outer(tx.tokens(text)).alias("w"))
        sign = F.when(F.col("w").isNull(), 0.0).when(F.pmod(F.xxhash64(F.lit(1), "w"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        sums = words.groupBy(key, F.pmod(F.xxhash64("w"), F.lit(width)).cast("int").alias("p")).agg(F.sum(sign).alias("s"))
        rows = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("p", "s"))).alias("m"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("n"))
        value = lambda i: F.when(F.col("n") == 0, 0.0).otherwise(F.coalesce(F.element_at("m", i), F.lit(0.0)) / F.col("n"))
        return rows.select(key, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), value).alias("embedding"))

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        made = [list(map(float, v)) for v in model(texts.fillna("").tolist())]
        return pd.Series([[x / (sum(y * y for y in v) ** 0.5 or 1.0) for x in v] for v in made])

    return docs.select(key, encode(text).alias("embedding"))
