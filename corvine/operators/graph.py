"""Graph operators on edge tables with the columns ``src`` and ``dst``.

Searches that need only distances run level by level; each level is a join of
the frontier with the edges, an anti join with what was seen, and a reliable
checkpoint that cuts the lineage. Searches that enumerate paths have a bounded
depth and carry the path as an array.

Null ends are no edges. Self-loops and parallel edges are allowed. Empty tables
give empty results. Columns other than those named aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.session import checkpoint_dir


def ends(edges: DataFrame) -> DataFrame:
    """``src, dst``, distinct and without nulls."""
    return edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


def call_chains(edges: DataFrame, start: DataFrame, max_depth: int = 10, active: Column | None = None) -> DataFrame:
    """``caller, callee, distance, chain, active``: who calls a start node, directly or through others.

    Every edge into a visited node comes out, repeats included; a node is
    expanded once, on its first level, and its chain (from the start node to it)
    is that of the smallest node below it. ``active`` is a condition on the
    edge, true if not given.
    """
    back = ends(reverse(edges))
    seen = levels(back, start, max_depth - 1)
    chain = seen.filter("depth = 0").select("node", F.array("node").alias("chain"), "depth")
    parts = [chain]
    for d in range(1, max_depth):
        step = seen.filter(F.col("depth") == d).join(chain.select(F.col("node").alias("parent"), F.col("chain").alias("below")), "parent")
        chain = step.select("node", F.array_append("below", F.col("node")).alias("chain"), F.lit(d).alias("depth"))
        parts.append(chain)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    live = edges.filter("src IS NOT NULL").withColumn("active", F.coalesce(active if active is not None else F.lit(True), F.lit(False)))
    hit = live.join(every.withColumnRenamed("node", "dst"), "dst")
    return hit.select(F.col("src").alias("caller"), F.col("dst").alias("callee"), (F.col("depth") + 1).alias("distance"), F.array_append("chain", F.col("src")).alias("chain"), "active")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def edge_filter(call_type: str | None = None, conditional_only: bool = False, guard: str | None = None, least_confidence: int | None = None) -> Column:
    """The filter of a traversal: call type, conditional only, exact guard, ordinal confidence."""
    keep = F.lit(True)
    if call_type is not None:
        keep &= F.col("call_type") == call_type
    if conditional_only:
        keep &= F.coalesce(F.col("conditional"), F.lit(False))
    if guard is not None:
        keep &= F.col("config_guard") == guard
    if least_confidence is not None:
        keep &= F.element_at(F.create_map(*[F.lit(x) for p in (("high", 3), ("medium", 2), ("low", 1)) for x in p]), F.col("confidence")) >= least_confidence
    return keep


NEAR = 100_000  # nodes that are sent to every task instead of shuffling the edges


class _Search:
    """Breadth-first search level by level; each level is written once and its size counted.

    A frontier of up to NEAR nodes is broadcast, so the edges aren't shuffled;
    a larger one is joined by shuffle, where Spark splits hot nodes.
    """

    def __init__(self, edges: DataFrame, start: DataFrame) -> None:
        kind = edges.schema["src"].dataType
        self.edges, self.depth = edges, 0
        self.frontier = start.select("node").filter("node IS NOT NULL").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent")).checkpoint()
        self.size = self.n_found = self.frontier.count()
        self.found = self.frontier

    def step(self) -> bool:
        """Goes one level on; False if nothing new was found."""
        self.depth += 1
        small = self.frontier.select(F.col("node").alias("src"))
        known = self.found.select("node")
        step = self.edges.join(F.broadcast(small) if self.size <= NEAR else small, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        fresh = step.join(F.broadcast(known) if self.n_found <= NEAR else known, "node", "left_anti")
        self.frontier = fresh.select("node", F.lit(self.depth).alias("depth"), "parent").checkpoint()
        self.size = self.frontier.count()
        if not self.size:
            return False
        self.n_found += self.size
        self.found = self.found.unionByName(self.frontier)
        if self.depth % 8 == 0:
            self.found = self.found.checkpoint()
        return True


def levels(edges: DataFrame, start: DataFrame, max_depth: int | None = None, stop: DataFrame | None = None) -> DataFrame:
    """``node, depth, parent``: breadth-first search from the column ``node`` of ``start``.

    Depth is the least number of edges; the parent is the smallest node one
    level up. Start nodes have depth 0 and no parent, whether they have edges or
    not. Stops at ``max_depth``, when nothing new is found, or after the level
    in which a node of ``stop`` is reached.
    """
    checkpoint_dir(edges.sparkSession)
    search = _Search(ends(edges).checkpoint(), start)
    while (max_depth is None or search.depth < max_depth) and search.step():
        if stop is not None and not search.frontier.join(stop.select("node"), "node", "left_semi").isEmpty():
            break
    return search.found


def ancestors(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes that reach a start node, without the start unless a cycle leads back to it.

    ``max_depth`` counts expansions: nodes up to max_depth + 1 edges away come out.
    """
    return descendants(reverse(edges), start, max_depth)


def descendants(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``node``: what a start node reaches; see ``ancestors``."""
    seen = levels(edges, start, None if max_depth is None else max_depth + 1)
    away = seen.filter("depth > 0").select("node")
    inner = seen if max_depth is None else seen.filter(F.col("depth") <= max_depth)
    back = inner.select(F.col("node").alias("src")).join(ends(edges), "src").select(F.col("dst").alias("node")).join(start.select("node"), "node", "left_semi")
    return away.unionByName(back).distinct()


def traversed_edges(edges: DataFrame, visited: DataFrame) -> DataFrame:
    """All out-edges of visited nodes, those at the depth limit included."""
    return edges.join(visited.select(F.col("node").alias("src")), "src", "left_semi")


def shortest_path(edges: DataFrame, source, target, max_depth: int | None = None) -> DataFrame:
    """``pos, node``: the nodes of a shortest path; no rows if there is none.

    Of equally short paths the one with the smallest parents, read from the end.
    The walk back is one job, a join with one level after another.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    node = lambda v: spark.createDataFrame([(v,)], "node long").select(F.col("node").cast(kind).alias("node"))
    seen = levels(edges, node(source), max_depth, node(target))
    end = seen.filter(F.col("node") == target)
    length = end.agg(F.max("depth").alias("d")).first().d
    if length is None:
        return spark.createDataFrame([], "pos int, node long")
    out = at = end.select(F.col("depth").alias("pos"), "node", "parent")
    for d in range(length - 1, -1, -1):
        level = seen.filter(F.col("depth") == d).select(F.col("depth").alias("pos"), "node", F.col("parent").alias("up"))
        at = level.join(F.broadcast(at.select(F.col("parent").alias("node"))), "node").select("pos", "node", F.col("up").alias("parent"))  # one row
        out = out.unionByName(at)
    return out.select("pos", F.col("node").cast("long").alias("node"))


def bidirectional_distance(edges: DataFrame, source, target, max_depth: int = 20) -> DataFrame:
    """``meeting, length``: the shortest way by two frontiers, the smaller of which grows; no rows if there is none.

    The search ends with the level in which the frontiers meet.
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    node = lambda v: spark.createDataFrame([(v,)], "node long")
    edges = ends(edges).checkpoint()
    down, up = _Search(edges, node(source)), _Search(reverse(edges), node(target))

    def meeting() -> DataFrame:
        a, b = down.found.select("node", F.col("depth").alias("a")), up.found.select("node", F.col("depth").alias("b"))
        return a.join(b, "node").select(F.col("node").alias("meeting"), (F.col("a") + F.col("b")).alias("length"))

    found = meeting()
    while found.isEmpty() and down.depth + up.depth < max_depth:
        if not (down if down.size <= up.size else up).step():
            break
        found = meeting()
    return found.orderBy("length", "meeting").limit(1)


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int, keep: list[str] | None = None) -> DataFrame:
    """``root, node, depth, path`` and the kept edge columns: simple paths of up to ``depth`` edges.

    The path holds the nodes after the root, so the root itself may come back
    once through a cycle. One row per path, so the result grows with the depth as
    the number of paths does; ``levels`` is the search without paths. Each hop is
    written, and joined by broadcast while it is small.
    """
    keep = keep or []
    checkpoint_dir(edges.sparkSession)
    edges = edges.select("src", "dst", *keep).filter("src IS NOT NULL AND dst IS NOT NULL")
    now = start.select(F.col("node").alias("root"), "node", F.array().cast(f"array<{edges.schema['dst'].dataType.simpleString()}>").alias("path")).distinct().checkpoint()
    out = None
    for d in range(1, depth + 1):
        size = now.count()
        heads = now.select(F.col("root").alias("__root"), F.col("node").alias("src"), F.col("path").alias("__path"))
        step = edges.join(F.broadcast(heads) if size <= NEAR else heads, "src").filter(~F.array_contains("__path", F.col("dst")))
        # what is delivered again is dropped here, where it is little
        step = step.select(F.col("__root").alias("root"), F.col("dst").alias("node"), F.array_append("__path", F.col("dst")).alias("path"), *keep).distinct()
        now = step.select("root", "node", F.lit(d).alias("depth"), "path", *keep).checkpoint()
        out = now if out is None else out.unionByName(now)
        if now.isEmpty():
            break
        # parallel edges of other kinds lead to the same paths
        now = now.select("root", "node", "path").distinct() if keep else now
    return out if out is not None else now.select("root", "node", F.lit(0).alias("depth"), "path", *[F.lit(None).alias(c) for c in keep]).limit(0)


def all_paths(edges: DataFrame, source, target, max_edges: int, weight: str | None = None) -> DataFrame:
    """``path, length`` (and ``score``): simple paths of at most ``max_edges`` edges.

    The target is never passed through. Parallel edges give a path each if
    ``weight`` names a column, else one. With equal source and target the cycles
    through it come out. The score is the product of the weights. Only nodes
    that still reach the target in the edges that are left are walked.
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    columns = ["src", "dst", *([weight] if weight else [])]
    edges = edges.select(*columns).filter("src IS NOT NULL AND dst IS NOT NULL")
    edges = (edges if weight else edges.distinct()).checkpoint()
    kind = edges.schema["dst"].dataType
    away = levels(reverse(edges), spark.createDataFrame([(target,)], "node long").select(F.col("node").cast(kind).alias("node")), max_edges - 1)
    n_away = away.count()
    away = away.select(F.col("node").alias("dst"), F.col("depth").alias("__left"))
    ahead = edges.join(F.broadcast(away) if n_away <= NEAR else away, "dst").select("src", F.col("dst").alias("__next"), "__left", (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("__score")).checkpoint()
    now = ahead.filter((F.col("src") == source) & (F.col("__left") <= max_edges - 1)).select(F.array("src", "__next").alias("path"), F.col("__next").alias("node"), F.col("__score").alias("score"))
    done = []
    for d in range(1, max_edges + 1):
        done.append(now.filter(F.col("node") == target).select("path", F.lit(d).alias("length"), "score"))
        if d == max_edges:
            break
        fresh = ~F.expr("array_contains(path, __next)") | (F.col("__next") == F.lit(target))
        now = now.filter(F.col("node") != target).join(ahead.filter(F.col("__left") <= max_edges - d - 1), (F.col("node") == F.col("src")) & fresh)
        now = now.select(F.array_append("path", F.col("__next")).alias("path"), F.col("__next").alias("node"), (F.col("score") * F.col("__score")).alias("score"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out if weight else out.select("path", "length")


def top_paths(edges: DataFrame, source, target, max_depth: int, k: int, weight: str) -> DataFrame:
    """The ``k`` best of ``all_paths`` by score; ties by length, then by the nodes."""
    return all_paths(edges, source, target, max_depth - 1, weight).orderBy(F.col("score").desc(), "length", "path").limit(k)


def cycles_up_to(edges: DataFrame, max_edges: int) -> DataFrame:
    """``nodes, length``: simple cycles of 2..max_edges edges, one per set of nodes.

    Each cycle is walked from its smallest node only. Self-loops don't count.
    """
    edges = ends(edges).filter("src <> dst").select("src", "dst")
    now = edges.filter("src < dst").select(F.col("src").alias("root"), F.array("src", "dst").alias("path"), F.col("dst").alias("node"))
    found = []
    for d in range(2, max_edges + 1):
        closing = edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        found.append(now.join(closing, ["node", "root"]).select(F.array_sort("path").alias("nodes"), F.lit(d).alias("length")))
        if d < max_edges:
            ahead = edges.select("src", F.col("dst").alias("__next"))
            now = now.join(ahead, (F.col("node") == F.col("src")) & (F.col("__next") > F.col("root")) & ~F.expr("array_contains(path, __next)"))
            now = now.select("root", F.array_append("path", F.col("__next")).alias("path"), F.col("__next").alias("node"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.distinct()


def topological_levels(edges: DataFrame) -> DataFrame:
    """``node, level``: Kahn's peeling; nodes on or behind a cycle have a null level.

    A self-loop is a cycle. Order by (level, node) for a topological order.
    """
    checkpoint_dir(edges.sparkSession)
    rest = ends(edges).checkpoint()
    nodes = rest.select(F.col("src").alias("node")).unionByName(rest.select(F.col("dst").alias("node"))).distinct().checkpoint()
    parts, level = [], 0
    while True:
        free = nodes.join(rest.select(F.col("dst").alias("node")), "node", "left_anti").select("node", F.lit(level).alias("level")).checkpoint()
        if free.isEmpty():
            break
        parts.append(free)
        nodes = nodes.join(free.select("node"), "node", "left_anti").checkpoint()
        rest = rest.join(free.select(F.col("node").alias("src")), "src", "left_anti").checkpoint()
        level += 1
    out = nodes.select("node", F.lit(None).cast("int").alias("level"))
    for part in parts:
        out = out.unionByName(part)
    return out


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: strongly connected components, named by their smallest node.

    Nodes without an edge in or out are peeled off first. Then the smallest
    reachable-from label spreads forward until it rests; nodes that reach their
    label's node backwards within one label form its component, and the rest
    goes round again.
    """
    checkpoint_dir(edges.sparkSession)
    rest = ends(edges).filter("src <> dst").checkpoint()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).filter("node IS NOT NULL").distinct().checkpoint()
    done = []
    while True:
        for _ in range(50):  # peeling only saves time; any number of rounds is right
            inner = rest.select(F.col("src").alias("node")).distinct().join(rest.select(F.col("dst").alias("node")).distinct(), "node", "left_semi").checkpoint()
            kept = rest.join(inner.select(F.col("node").alias("src")), "src", "left_semi").join(inner.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst").checkpoint()
            stable = kept.count() == rest.count()
            rest = kept
            if stable:
                break
        outer = nodes.join(inner, "node", "left_anti")
        done.append(outer.select("node", F.col("node").alias("component")).checkpoint())
        nodes = inner
        if nodes.isEmpty():
            break
        label = nodes.select("node", F.col("node").alias("label"))
        while True:
            sent = label.withColumnRenamed("node", "src").join(rest, "src").select(F.col("dst").alias("node"), "label")
            grown = label.withColumn("old", F.col("label")).unionByName(sent, allowMissingColumns=True).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")).checkpoint()
            moved = not grown.filter("label <> old").isEmpty()
            label = grown.select("node", "label")
            if not moved:
                break
        within = rest.join(label.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(label.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").filter("a = b").select("src", "dst", "a").checkpoint()
        reached = label.filter("node = label").checkpoint()
        frontier = reached
        while not frontier.isEmpty():
            back = frontier.select(F.col("node").alias("dst"), F.col("label").alias("a")).join(within, ["dst", "a"]).select(F.col("src").alias("node"), F.col("a").alias("label")).distinct()
            frontier = back.join(reached, ["node", "label"], "left_anti").checkpoint()
            reached = reached.unionByName(frontier).checkpoint()
        done.append(reached.select("node", F.col("label").alias("component")))
        nodes = nodes.join(reached.select("node"), "node", "left_anti").checkpoint()
        gone = reached.select("node")
        rest = rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst").checkpoint()
        if nodes.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def cycle_summary(edges: DataFrame, comps: DataFrame | None = None) -> DataFrame:
    """``component, n_nodes, self_loop``: the components that hold a cycle, largest first."""
    comps = comps if comps is not None else components(edges)
    loops = ends(edges).filter("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop"))
    joined = comps.join(loops, "node", "left")
    out = joined.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.bool_or("loop"), F.lit(False)).alias("self_loop"))
    return out.filter("n_nodes > 1 OR self_loop").orderBy(F.col("n_nodes").desc(), "component")


def condensation(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """``src, dst``: distinct edges between different components."""
    a = comps.select(F.col("node").alias("src"), F.col("component").alias("a"))
    b = comps.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    return ends(edges).join(a, "src").join(b, "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def component_levels(edges: DataFrame) -> DataFrame:
    """``node, component, level``: the topological level of each node's strongly connected component.

    Cycles have one level, that of their component in the condensation, so no
    level is null. Components without an edge to or from another have level 0.
    """
    checkpoint_dir(edges.sparkSession)
    comps = components(edges).checkpoint()
    levels = topological_levels(condensation(edges, comps)).withColumnRenamed("node", "component")
    return comps.join(levels, "component", "left").select("node", "component", F.coalesce("level", F.lit(0)).alias("level"))


def first_callee_flow(edges: DataFrame, names: DataFrame, start: DataFrame, hops: int = 5) -> DataFrame:
    """``root, hop, node``: follows from each start node the callee with the smallest name.

    Ends after ``hops`` steps, without a callee, or before a node comes twice.
    ``names`` has ``node, name``; of equal names the smallest node is taken.
    """
    named = ends(edges).join(names.select(F.col("node").alias("dst"), "name"), "dst")
    first = named.groupBy("src").agg(F.min(F.struct("name", "dst")).alias("f")).select("src", F.col("f.dst").alias("__next"))
    now = start.select(F.col("node").alias("root"), F.col("node"), F.array("node").alias("path")).distinct()
    out = now.select("root", F.lit(0).alias("hop"), "node")
    for h in range(1, hops + 1):
        now = now.join(first, F.col("node") == F.col("src")).filter(~F.expr("array_contains(path, __next)"))
        now = now.select("root", F.col("__next").alias("node"), F.array_append("path", F.col("__next")).alias("path"))
        out = out.unionByName(now.select("root", F.lit(h).alias("hop"), "node"))
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """``node, n_out, n_in``: numbers of distinct neighbours; both ends are aggregated before they meet."""
    e = ends(edges)
    parts = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out")).withColumn("n_in", F.lit(0).cast("long"))
    other = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in")).withColumn("n_out", F.lit(0).cast("long"))
    return parts.unionByName(other).groupBy("node").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))


def size_statistics(edges: DataFrame) -> DataFrame:
    """``n_nodes, n_edges, average_degree, density`` of the distinct edges, in one row."""
    d = degrees(edges).agg(F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.sum("n_out"), F.lit(0)).alias("n_edges"))
    n, m = F.col("n_nodes").cast("double"), F.col("n_edges").cast("double")
    return d.withColumn("average_degree", F.when(n > 0, 2 * m / n).otherwise(0.0)).withColumn("density", F.when(n > 1, F.least(2 * m / (n * (n - 1)), F.lit(1.0))).otherwise(0.0))


def boundary_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """``src, dst, src_part, dst_part``: edges whose ends lie in different parts (``node, part``)."""
    a = parts.select(F.col("node").alias("src"), F.col("part").alias("src_part"))
    b = parts.select(F.col("node").alias("dst"), F.col("part").alias("dst_part"))
    return ends(edges).join(a, "src").join(b, "dst").filter("src_part <> dst_part")


def expand_path(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Path rows with an array ``edge_ids`` and their edges in the order of the array."""
    return paths.select("path_id", F.posexplode("edge_ids").alias("pos", "edge_id")).join(edges.withColumnRenamed("id", "edge_id"), "edge_id")


def refresh_paths(cache: DataFrame, fresh: DataFrame, now: str, keep_days: int) -> DataFrame:
    """``source, target, edge_ids, computed_at, access_count``: a path cache after new paths were found.

    Of each (source, target) the path computed last stays, with the accesses of
    all of them. Paths older than ``keep_days`` that nobody asked for are dropped.
    Null ends are no paths; repeated rows count once.
    """
    rows = cache.unionByName(fresh).filter("source IS NOT NULL AND target IS NOT NULL").distinct()
    order = F.struct("computed_at", F.size("edge_ids"), "edge_ids")
    merged = rows.groupBy("source", "target").agg(F.max_by(F.struct("edge_ids", "computed_at"), order).alias("p"), F.sum("access_count").alias("access_count"))
    out = merged.select("source", "target", "p.edge_ids", "p.computed_at", "access_count")
    return out.filter((F.col("access_count") > 0) | (F.col("computed_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(keep_days))))


def cycle_edges(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """``component, src, dst``: the distinct edges that lie on a cycle, self-loops included: both ends in one component."""
    a = comps.select(F.col("node").alias("src"), F.col("component"))
    b = comps.select(F.col("node").alias("dst"), F.col("component").alias("__b"))
    inner = ends(edges).join(a, "src").join(b, "dst").filter(F.col("component") == F.col("__b"))
    return inner.select("component", "src", "dst")


def witness_cycles(edges: DataFrame, comps: DataFrame, most: int = 50) -> DataFrame:
    """``component, pos, node``: for each component with a cycle a shortest cycle through its smallest node.

    All components are walked at once, level by level within their own edges;
    ``most`` bounds the length, components whose cycle is longer give no rows.
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    inner = cycle_edges(edges, comps).checkpoint()
    first = inner.groupBy("component").agg(F.min("src").alias("root"))
    now = first.select("component", "root", F.col("root").alias("node"), F.array("root").alias("path"))
    seen, found = now.select("component", "node"), []
    for _ in range(most):
        step = now.join(inner, (now["component"] == inner["component"]) & (now["node"] == inner["src"])).select(now["component"], "root", F.col("dst").alias("node"), "path")
        best = step.groupBy("component", "root", "node").agg(F.min("path").alias("path")).checkpoint()
        found.append(best.filter("node = root").select("component", "path"))
        now = best.filter("node <> root").join(found[-1].select("component"), "component", "left_anti").join(seen, ["component", "node"], "left_anti")
        now = now.select("component", "root", "node", F.array_append("path", F.col("node")).alias("path")).checkpoint()
        seen = seen.unionByName(now.select("component", "node"))
        if now.isEmpty():
            break
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select("component", F.posexplode("path").alias("pos", "node"))


def path_is_valid(hops: Column) -> Column:
    """Whether an array of (src, dst) structs is contiguous; empty and null aren't."""
    pairs = F.arrays_zip(F.slice(hops, 1, F.size(hops) - 1).alias("a"), F.slice(hops, 2, F.size(hops) - 1).alias("b"))
    return F.coalesce((F.size(hops) > 0) & F.when(F.size(hops) > 1, F.forall(pairs, lambda p: p["a"]["dst"] == p["b"]["src"])).otherwise(True), F.lit(False))


def visit_order(edges: DataFrame, start, max_depth: int | None = None, max_nodes: int = 1_000_000) -> DataFrame:
    """``pos, node, depth``: depth-first preorder, callees in ascending order.

    Depth-first order is sequential by nature. The reachable part of the graph
    is found in parallel; one task then walks it, which is refused beyond
    ``max_nodes``. With ``max_depth`` a node may be missed that a shorter way
    would reach, as depth is that of the walk.
    """
    spark = edges.sparkSession
    seen = levels(edges, spark.createDataFrame([(start,)], "node long"), max_depth)
    if seen.limit(max_nodes + 1).count() > max_nodes:
        raise ValueError(f"more than {max_nodes} nodes can be reached; a depth-first order isn't distributed")
    part = ends(edges).join(seen.select(F.col("node").alias("src")), "src", "left_semi")
    rows = part.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("out")).coalesce(1)

    def walk(batches):
        import pandas as pd

        out = {}
        for b in batches:
            out.update(zip(b["src"], b["out"]))
        order, seen_nodes, stack = [], set(), [(start, 0)]
        while stack:
            node, depth = stack.pop()
            if node in seen_nodes:
                continue
            seen_nodes.add(node)
            order.append((len(order), node, depth))
            if max_depth is None or depth < max_depth:
                stack += [(n, depth + 1) for n in reversed(list(out.get(node, ()))) if n not in seen_nodes]
        yield pd.DataFrame(order, columns=["pos", "node", "depth"])

    return rows.mapInPandas(walk, "pos long, node long, depth int")
