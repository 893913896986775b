"""Mixing sources to target weights.

Target weights run down a tree of domains, languages and sources. A budget is
divided among the children of a node by weight; what a child can't use goes to
its siblings, and only what none of them can use goes back up. A leaf's budget
is met by whole epochs and the prefix of one more, in an order drawn from a
seed; the place where the prefix ends comes from two histograms of order values,
the second within one bucket of the first. One row a leaf says where it ends, so
no row is shuffled and no leaf is ever sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.session import checkpoint_dir

BITS = 12  # of the order that one histogram tells apart


@dataclass
class Node:
    """weight and capacity of a node are those of the leaves below it."""

    weight: float = 0.0
    capacity: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)

    def add(self, path: tuple[str, ...], weight: float, capacity: float) -> None:
        self.weight += weight
        self.capacity += capacity
        if path:
            self.children.setdefault(path[0], Node()).add(path[1:], weight, capacity)


def fill(shares: list[tuple[float, float]], budget: float) -> list[float]:
    """Divides a budget by weight among (weight, capacity) pairs, none above its capacity.

    Children without weight only take what those with weight can't.
    """
    given = [0.0] * len(shares)
    for weights in ([w for w, _ in shares], [0.0 if w > 0 else c for w, c in shares]):
        active = [i for i, w in enumerate(weights) if w > 0 and shares[i][1] > given[i]]
        while active and budget > 1e-9:
            total = sum(weights[i] for i in active)
            full = [i for i in active if budget * weights[i] / total >= shares[i][1]]
            if not full:
                for i in active:
                    given[i] = budget * weights[i] / total
                return given
            for i in full:
                given[i] = shares[i][1]
            budget -= sum(shares[i][1] for i in full)
            active = [i for i in active if i not in full]
    return given


def budgets(node: Node, budget: float, path: tuple[str, ...] = ()) -> dict[tuple[str, ...], float]:
    """The budget of every leaf. Shortages stay among siblings where these have room."""
    if not node.children:
        return {path: min(budget, node.capacity)}
    names = sorted(node.children)
    given = fill([(node.children[n].weight, node.children[n].capacity) for n in names], min(budget, node.capacity))
    out: dict[tuple[str, ...], float] = {}
    for name, part in zip(names, given):
        out |= budgets(node.children[name], part, (*path, name))
    return out


def clean_source(c: Column | str) -> Column:
    """Lower case without surrounding white space; null stays null."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def clean_language(c: Column | str, known: list[str]) -> Column:
    """The primary subtag in lower case if it is known, else ``und``."""
    primary = F.lower(F.split_part(F.trim(c), F.lit("-"), F.lit(1)))
    return F.when(primary.isin(known), primary).otherwise("und")


def plan(leaves: list[tuple[str, str, str, int]], targets: dict[str, tuple[float, int]], total: int | None = None) -> list[tuple[str, str, str, int, int]]:
    """(domain, language, source, whole epochs, tokens of the last prefix) of each leaf.

    leaves: (domain, language, source, tokens). A source's weight is divided
    among its leaves by their tokens. ``total`` defaults to one epoch of all
    sources that have a target.
    """
    have: dict[str, int] = {}
    for _, _, source, tokens in leaves:
        have[source] = have.get(source, 0) + tokens
    root = Node()
    for domain, language, source, tokens in leaves:
        share, repeats = targets.get(source, (0.0, 0))
        if tokens > 0 and share > 0 and repeats > 0:
            root.add((domain, language, source), share * tokens / have[source], tokens * repeats)
    wanted = total if total is not None else sum(n for s, n in have.items() if targets.get(s, (0, 0))[0] > 0)
    given = budgets(root, wanted) if root.children else {}
    size = {leaf[:3]: leaf[3] for leaf in leaves}
    out = []
    for leaf, budget in given.items():
        whole = int((budget + 1e-6) // size[leaf])
        out.append((*leaf, whole, int(budget + 1e-6) - whole * size[leaf]))
    return out


def _ending(rows: DataFrame, leaf: list[str], bucket: str, rest: str) -> DataFrame:
    """``<leaf>, <bucket>_end, rest``: the bucket in which each leaf's prefix ends, and what is left of the budget there.

    A prefix is shorter than its leaf, so it always ends in one of the buckets.
    """
    sums = rows.groupBy(*leaf, rest, bucket).agg(F.sum("n_tokens").alias("inside"))
    running = Window.partitionBy(*leaf).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)  # at most 4,096 rows
    over = sums.withColumn("after", F.sum("inside").over(running)).filter(F.col("after") > F.col(rest))
    return over.groupBy(*leaf).agg(F.min_by(F.struct(F.col(bucket).alias("b"), (F.col(rest) - F.col("after") + F.col("inside")).alias("r")), bucket).alias("x")).select(*leaf, F.col("x.b").alias(f"{bucket}_end"), F.col("x.r").alias("rest"))


def mix(sized: DataFrame, key: str, source: str, language: str, tokens: str, targets: dict[str, tuple[float, int]], domains: dict[str, str], languages: list[str], seed: int = 17, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The chosen records and the report.

    Chosen: ``<key>, source, language, n_tokens, copies``, one row per record
    that is used, with how often. Report: ``source, target_share, max_repeats,
    available_tokens, used_tokens, actual_share, most_copies``, one row per
    source with a target.

    Sources are compared in lower case without surrounding blanks; records
    without a known source aren't used, unknown or null languages are ``und``. A
    record is used whole; the one where a leaf's budget ends is taken if that
    misses the budget by less than leaving it. None is used more often than
    max_repeats. Empty records are never
    used. A source without records gets nothing and its share goes to siblings.
    Keys may repeat, each row is a record of its own. Targets and languages are parameters, so the number of
    leaves is bounded.
    """
    spark = sized.sparkSession
    checkpoint_dir(spark)
    domain = F.create_map(*[F.lit(x) for s in targets for x in (s, domains.get(s, "other"))])
    rows = sized.select(F.col(key).alias("key"), clean_source(source).alias("source"), clean_language(language, languages).alias("language"), F.col(tokens).cast("long").alias("n_tokens"))
    rows = rows.filter(F.col("source").isin(list(targets)) & (F.col("n_tokens") > 0)).withColumn("domain", domain[F.col("source")]).checkpoint()
    leaves = [tuple(r) for r in rows.groupBy("domain", "language", "source").agg(F.sum("n_tokens")).collect()]
    planned = spark.createDataFrame(plan(leaves, targets, total), "domain string, language string, source string, whole int, rest long")

    leaf = ["domain", "language", "source"]
    # the seed and the number of the epoch make the order; its top bits are the buckets
    ordered = rows.join(F.broadcast(planned), leaf).withColumn("place", F.xxhash64(F.lit(seed), "whole", "key"))
    ordered = ordered.withColumns({"coarse": F.shiftright("place", 64 - BITS), "fine": F.shiftright("place", 64 - 2 * BITS)})
    first = _ending(ordered, leaf, "coarse", "rest")
    second = _ending(ordered.drop("rest").join(F.broadcast(first), leaf).filter("coarse = coarse_end"), leaf, "fine", "rest")
    ends = first.drop("rest").join(second, leaf)  # one row a leaf
    placed = ordered.drop("rest").join(F.broadcast(ends), leaf)
    before, at = F.col("fine") < F.col("fine_end"), F.col("fine") == F.col("fine_end")
    clear = placed.filter(~at).withColumn("extra", before.cast("int"))
    # one of 16.8 million buckets of a leaf
    within = Window.partitionBy(*leaf).orderBy("place", "key").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.filter(at).withColumn("extra", F.when(F.sum("n_tokens").over(within) - F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0))
    copies = clear.unionByName(edge).withColumn("copies", F.col("whole") + F.col("extra")).filter("copies > 0")
    chosen = copies.select(F.col("key").alias(key), "source", "language", "n_tokens", "copies")

    wanted = spark.createDataFrame([(s, float(w), int(r)) for s, (w, r) in targets.items()], "source string, target_share double, max_repeats int")
    available = rows.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    used = copies.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    report = wanted.join(available, "source", "left").join(used, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    share = F.col("used_tokens") / F.sum("used_tokens").over(Window.partitionBy())  # one row per target
    report = report.select("source", "target_share", "max_repeats", zero("available_tokens").alias("available_tokens"), zero("used_tokens").alias("used_tokens"), F.coalesce(share, F.lit(0.0)).alias("actual_share"), zero("most_copies").alias("most_copies"))
    return chosen, report
