"""Work lists as tables: what is to be done, what was claimed, what failed, what must be done again; caches of answers.

Every function returns the new content of a table. A status is compared without
regard to letter case; null counts as pending. Repeated rows are taken one by one
unless stated; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The states of an item.
PENDING, PROCESSING, COMPLETED, FAILED = "PENDING", "PROCESSING", "COMPLETED", "FAILED"


def state(c: Column | str = "status") -> Column:
    return F.upper(F.coalesce(c, F.lit(PENDING)))


def reindex(content: DataFrame, vectors: DataFrame, wanted: Column, now: str) -> tuple[DataFrame, DataFrame]:
    """Content (``id, status, chunk_count, indexed_at, updated_at``) with the wanted rows pending again, and vectors without theirs.

    Rows in work are left alone. Vectors go whose content is pending afterwards
    and wanted, whether it was reset now or pending before.
    """
    hit = F.coalesce(wanted, F.lit(False)) & (state() != PROCESSING)
    reset = {"status": F.lit(PENDING), "chunk_count": F.lit(0), "indexed_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(now).cast("timestamp")}
    fresh = content.withColumn("__hit", hit)
    gone = fresh.filter("__hit").select(F.col("id").alias("content_id")).distinct()
    return fresh.withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in reset.items()}).drop("__hit"), vectors.join(gone, "content_id", "left_anti")


def enlist(known: DataFrame, chunks: DataFrame, force: bool = False) -> DataFrame:
    """``chunk_id, status, attempts, changed_at``: the known states and a pending one for every chunk without; all anew with ``force``."""
    new = chunks.select("chunk_id").filter("chunk_id IS NOT NULL").distinct()
    new = new if force else new.join(known.select("chunk_id"), "chunk_id", "left_anti")
    kept = known.join(new.select("chunk_id"), "chunk_id", "left_anti") if force else known
    return kept.unionByName(new.select("chunk_id", F.lit(PENDING).alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("timestamp").alias("changed_at")))


def claim(items: DataFrame, n: int, now: str, after: str | None = None) -> DataFrame:
    """The items with the first ``n`` pending ones, by id and behind ``after`` if given, in work.

    A top-n, not a sort of all: every task only sends its first n.
    """
    free = items.filter(state() == PENDING)
    free = free.filter(F.col("chunk_id") > after) if after is not None else free
    taken = free.select("chunk_id").distinct().orderBy("chunk_id").limit(n).withColumn("__taken", F.lit(True))
    marked = items.join(F.broadcast(taken), "chunk_id", "left")  # n rows
    hit = F.coalesce("__taken", F.lit(False)) & (state() == PENDING)
    return marked.withColumns({"status": F.when(hit, PROCESSING).otherwise(F.col("status")), "attempts": F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")), "changed_at": F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("changed_at"))}).drop("__taken")


def settle(items: DataFrame, results: DataFrame, now: str, most: int = 3) -> DataFrame:
    """Items in work with their results (``chunk_id, ok``): completed, pending again, or failed after ``most`` attempts.

    Of several results of an item one success is enough. Items that aren't in
    work ignore results that come late.
    """
    outcome = results.groupBy("chunk_id").agg(F.bool_or("ok").alias("__ok"))
    joined = items.join(outcome, "chunk_id", "left")
    hit = F.col("__ok").isNotNull() & (state() == PROCESSING)
    then = F.when(F.col("__ok"), COMPLETED).when(F.col("attempts") >= most, FAILED).otherwise(PENDING)
    return joined.withColumns({"status": F.when(hit, then).otherwise(F.col("status")), "changed_at": F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("changed_at"))}).drop("__ok")


def release(items: DataFrame, now: str, minutes: int, most: int = 3) -> DataFrame:
    """Items that are in work for longer than ``minutes``, or at a time unknown, are pending again, or failed after ``most`` attempts."""
    limit = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    stuck = (state() == PROCESSING) & F.coalesce(F.col("changed_at") < limit, F.lit(True))
    then = F.when(F.col("attempts") >= most, FAILED).otherwise(PENDING)
    return items.withColumns({"status": F.when(stuck, then).otherwise(F.col("status")), "changed_at": F.when(stuck, F.lit(now).cast("timestamp")).otherwise(F.col("changed_at"))})


def query_key(text: Column | str) -> Column:
    """The key of a question in a cache: SHA-256 of its lower case with single blanks."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 256)


def cached(cache: DataFrame, asked: DataFrame, now: str) -> DataFrame:
    """``query_id, answer``: for each question (``query_id, key, version``) the latest answer (``key, version, answer, created_at, expires_at``) that hasn't expired.

    A null version in the question takes any. Equal times go to the greatest answer.
    """
    live = cache.filter(F.col("expires_at") > F.lit(now).cast("timestamp")).withColumnRenamed("version", "__version")
    hit = asked.join(live, "key").filter(F.col("version").isNull() | F.col("version").eqNullSafe(F.col("__version")))
    return hit.groupBy("query_id").agg(F.max_by("answer", F.struct("created_at", "answer")).alias("answer"))


def with_answers(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache (with ``hits``) after new answers: one row per key and version, the latest, with one hit more for each that it replaces."""
    both = cache.unionByName(new)
    rank = Window.partitionBy("key", "version").orderBy(F.col("created_at").desc(), F.col("answer").desc())
    # a key has few answers at a time: the cache has one, new ones are those of one run
    return both.withColumn("__n", F.row_number().over(rank)).withColumn("hits", F.max("hits").over(Window.partitionBy("key", "version")) + F.count(F.lit(1)).over(Window.partitionBy("key", "version")) - 1).filter("__n = 1").drop("__n")
