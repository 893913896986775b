"""Queries of the graph operators over symbols and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators import graph
from corvine.plans import views as v
from corvine.session import checkpoint_dir
from corvine.sources.tables import table

# Numbers for the texts of ``confidence`` in the score of a path.
PATH_WEIGHT = {"high": 0.9, "medium": 0.7, "low": 0.5}


def _pick(df: DataFrame, column: str, best) -> int:
    return df.agg(best(column).alias("x")).first().x


def _root(spark: SparkSession, base: str) -> DataFrame:
    """The caller with most callees, of equals the smallest."""
    return v.graph(spark, base).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "node").limit(1).select("node")


def _ends(spark: SparkSession, base: str) -> tuple[int, int]:
    """The root, and the greatest node three calls away from it."""
    g = v.graph(spark, base)
    root = _root(spark, base).first().node
    seen = graph.levels(g, spark.createDataFrame([(root,)], "node long"), 3)
    return root, _pick(seen.filter("depth = 3"), "node", F.max)


def _leaf(spark: SparkSession, base: str) -> DataFrame:
    """The callee with the greatest id."""
    return v.graph(spark, base).agg(F.max("dst").alias("node"))


def _typed(spark: SparkSession, base: str) -> DataFrame:
    return v.edges(spark, base).select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), "call_type", "confidence", "conditional", "config_guard", "line_number", "file_path", "id")


def _calls(spark: SparkSession, base: str) -> DataFrame:
    """Ends and type only; ``neighbourhood`` drops what is delivered again, so no other column is shuffled."""
    return table(spark, base, "call_edges").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), "call_type")


def _names(spark: SparkSession, base: str) -> DataFrame:
    return v.symbols(spark, base).select(F.col("id").alias("node"), "name")


def _hop_rows(spark: SparkSession, base: str, edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    hops = graph.neighbourhood(edges, start, depth, ["call_type"]).select("node", "call_type", "depth").distinct()
    sym = v.symbols(spark, base).select(F.col("id").alias("node"), F.col("name").alias("symbol"), "file_id", "start_line", "end_line")
    file = v.files(spark, base).select(F.col("id").alias("file_id"), "path", "sha")
    rows = hops.join(sym, "node").join(file, "file_id")
    return rows.select("symbol", "path", "sha", "start_line", "end_line", "call_type", "depth").distinct()


def g_khop_down(spark: SparkSession, base: str) -> DataFrame:
    edges = _calls(spark, base)
    return _hop_rows(spark, base, edges, _root(spark, base), 3).orderBy("depth", "symbol", "call_type")


def g_khop_up(spark: SparkSession, base: str) -> DataFrame:
    edges = graph.reverse(_calls(spark, base))
    return _hop_rows(spark, base, edges, _leaf(spark, base), 3).orderBy("depth", "symbol", "call_type")


def g_neighbours(spark: SparkSession, base: str) -> DataFrame:
    edges, root, names = _typed(spark, base), _root(spark, base), _names(spark, base)
    out = edges.join(root.withColumnRenamed("node", "src"), "src").join(names.withColumnRenamed("node", "dst"), "dst")
    into = edges.join(root.withColumnRenamed("node", "dst"), "dst").join(names.withColumnRenamed("node", "src"), "src")
    side = lambda df, d: df.select(F.lit(d).alias("direction"), F.col("id").alias("edge_id"), "name", "call_type")
    return side(out, "callee").unionByName(side(into, "caller"))


def g_relationship_tree(spark: SparkSession, base: str) -> DataFrame:
    kept = _typed(spark, base).filter(graph.edge_filter("direct", least_confidence=2))
    tree = graph.neighbourhood(kept, _root(spark, base), 4)
    return tree.select("depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def g_reach_depth(spark: SparkSession, base: str) -> DataFrame:
    return graph.levels(v.graph(spark, base), _root(spark, base), 3).select("node", "depth")


def g_levels(spark: SparkSession, base: str) -> DataFrame:
    return graph.levels(v.graph(spark, base), _root(spark, base)).groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first_node"))


def g_descendants(spark: SparkSession, base: str) -> DataFrame:
    return graph.descendants(v.graph(spark, base), _root(spark, base), 1)


def g_ancestors(spark: SparkSession, base: str) -> DataFrame:
    return graph.ancestors(v.graph(spark, base), _leaf(spark, base), 1)


def g_traversed_edges(spark: SparkSession, base: str) -> DataFrame:
    kept = _typed(spark, base).filter(graph.edge_filter("direct"))
    seen = graph.levels(kept, _root(spark, base), 2)
    return graph.traversed_edges(kept, seen).select(F.col("id").alias("edge_id"), "src", "dst")


def g_shortest_length(spark: SparkSession, base: str) -> DataFrame:
    g = v.graph(spark, base)
    source, target = _ends(spark, base)
    found = graph.bidirectional_distance(g, source, target, 12)
    return found.select(F.lit(source).cast("long").alias("source"), F.lit(target).cast("long").alias("target"), "length")


def g_shortest_path(spark: SparkSession, base: str) -> DataFrame:
    g = v.graph(spark, base)
    return graph.shortest_path(g, *_ends(spark, base)).join(_names(spark, base), "node", "left")


def g_all_paths(spark: SparkSession, base: str) -> DataFrame:
    g = v.graph(spark, base)
    paths = graph.all_paths(g, *_ends(spark, base), 4)
    return paths.select(F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "length")


def _weighted(spark: SparkSession, base: str) -> DataFrame:
    weight = F.create_map(*[F.lit(x) for p in PATH_WEIGHT.items() for x in p])[F.col("confidence")]
    return _typed(spark, base).filter("src IS NOT NULL AND dst IS NOT NULL").withColumn("weight", F.coalesce(weight, F.lit(0.5))).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def g_top_paths(spark: SparkSession, base: str) -> DataFrame:
    g = _weighted(spark, base)
    paths = graph.top_paths(g, *_ends(spark, base), 5, 10, "weight")
    return paths.select(F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "length", F.round("score", 6).alias("score"))


def g_cycles(spark: SparkSession, base: str) -> DataFrame:
    found = graph.cycles_up_to(v.graph(spark, base), 3)
    return found.select(F.array_join(F.col("nodes").cast("array<string>"), "/").alias("nodes"), "length")


def _file_graph(spark: SparkSession, base: str) -> DataFrame:
    """``src, dst``: calls between files."""
    file_of = v.symbols(spark, base).select("id", "file_id")
    g = v.graph(spark, base)
    a = g.join(file_of.select(F.col("id").alias("src"), F.col("file_id").alias("a")), "src")
    return a.join(file_of.select(F.col("id").alias("dst"), F.col("file_id").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def g_self_loops(spark: SparkSession, base: str) -> DataFrame:
    """Files that call themselves."""
    return _file_graph(spark, base).filter("src = dst").select(F.col("src").alias("node"))


def g_cycle_checks(spark: SparkSession, base: str) -> DataFrame:
    """What must hold of components and cycles, as counts: each witness step is an edge and each witness stays in its component."""
    g = v.graph(spark, base)
    checkpoint_dir(spark)
    comps = graph.components(g).checkpoint()
    walk = graph.witness_cycles(g, comps).checkpoint()
    size = walk.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    nxt = walk.join(size, "component").withColumn("pos", F.pmod(F.col("pos") - 1, F.col("n"))).select("component", "pos", F.col("node").alias("dst"))
    steps = walk.withColumnRenamed("node", "src").join(nxt, ["component", "pos"])
    astray = walk.join(comps, ["node", "component"], "left_anti")
    two_way = g.join(graph.reverse(g), ["src", "dst"], "left_semi").join(comps.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(comps.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    counts = [
        ("nodes", comps), ("nodes named twice", comps.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")),
        ("steps that are no edge", steps.join(g, ["src", "dst"], "left_anti")), ("nodes outside of their component", astray),
        ("mutual calls", two_way), ("mutual calls between components", two_way.filter("a <> b")),
        ("edges of the condensation both ways", graph.condensation(g, comps).alias("x").join(graph.reverse(graph.condensation(g, comps)), ["src", "dst"], "left_semi")),
    ]
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n") for what, df in counts]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def g_path_refresh(spark: SparkSession, base: str) -> DataFrame:
    """A cache of one-call paths as of the first line of each call, refreshed with those of the last."""
    e = v.edges(spark, base).filter("caller_id IS NOT NULL AND callee_id IS NOT NULL")
    row = lambda used: e.select(F.col("caller_id").alias("source"), F.col("callee_id").alias("target"), F.array("id").alias("edge_ids"), F.col("created_at").alias("computed_at"), used.alias("access_count"))
    old, new = row((F.col("id") % 2).cast("long")).filter(F.element_at("edge_ids", 1) % 3 == 0), row(F.lit(0).cast("long")).filter(F.element_at("edge_ids", 1) % 3 > 0)
    kept = graph.refresh_paths(old, new, "2025-06-15 00:00:00", 7)
    return kept.select("source", "target", F.element_at("edge_ids", 1).alias("edge_id"), "access_count")


def g_components(spark: SparkSession, base: str) -> DataFrame:
    return graph.cycle_summary(v.graph(spark, base))


def g_topological(spark: SparkSession, base: str) -> DataFrame:
    """Levels of the calls from smaller to greater ids only, which have no cycle; ``g_topological_components`` has the whole graph."""
    return graph.topological_levels(v.graph(spark, base).filter("src < dst"))


def g_topological_cycles(spark: SparkSession, base: str) -> DataFrame:
    """Levels of all calls; null on and behind cycles. SQL can't follow cycles, so there is none."""
    return graph.topological_levels(v.graph(spark, base))


def g_topological_components(spark: SparkSession, base: str) -> DataFrame:
    """Levels of all calls, each cycle with the level of its component."""
    return graph.component_levels(v.graph(spark, base))


def g_first_callee_flow(spark: SparkSession, base: str) -> DataFrame:
    g = v.graph(spark, base)
    return graph.first_callee_flow(g, _names(spark, base), g.select(F.col("src").alias("node")), 5)


def g_call_chains(spark: SparkSession, base: str) -> DataFrame:
    found = graph.call_chains(_typed(spark, base), _leaf(spark, base), 2, F.col("config_guard").isNull())
    return found.groupBy("distance", "caller", "callee").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if("active").alias("n_active"))


def g_degrees(spark: SparkSession, base: str) -> DataFrame:
    return graph.degrees(v.graph(spark, base))


def g_size(spark: SparkSession, base: str) -> DataFrame:
    s = graph.size_statistics(v.graph(spark, base))
    return s.select("n_nodes", "n_edges", F.round("average_degree", 6).alias("average_degree"), F.round("density", 9).alias("density"))


def g_boundary(spark: SparkSession, base: str) -> DataFrame:
    """Calls between symbols of different kinds of file: the configuration is the part."""
    parts = v.symbols(spark, base).select(F.col("id").alias("node"), F.col("config").alias("part"))
    found = graph.boundary_edges(v.graph(spark, base), parts)
    return found.groupBy("src_part", "dst_part").agg(F.count(F.lit(1)).alias("n_edges"))


def g_path_cache(spark: SparkSession, base: str) -> DataFrame:
    """Cached paths - here the calls of each function in line order - expanded."""
    edges = v.edges(spark, base).filter("file_path IS NOT NULL")
    # a cached path is an array: a function's calls, which are few, not a file's
    paths = edges.groupBy(F.col("caller_id").alias("path_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "column_number", "id"))), lambda s: s["id"]).alias("edge_ids")).filter("path_id IS NOT NULL")
    rows = graph.expand_path(paths, edges.select("id", "caller_id", "callee_id"))
    return rows.select("path_id", "pos", "edge_id", "callee_id")


def g_preorder(spark: SparkSession, base: str) -> DataFrame:
    g = v.graph(spark, base)
    return graph.visit_order(g, _root(spark, base).first().node, 3)


QUERIES = {
    f.__name__: f
    for f in (
        g_khop_down, g_khop_up, g_neighbours, g_relationship_tree, g_reach_depth, g_levels, g_descendants, g_ancestors, g_traversed_edges, g_shortest_length,
        g_shortest_path, g_all_paths, g_top_paths, g_cycles, g_self_loops, g_cycle_checks, g_path_refresh, g_components, g_topological, g_topological_cycles, g_topological_components, g_first_callee_flow, g_call_chains, g_degrees, g_size,
        g_boundary, g_path_cache, g_preorder,
    )
}


def _hops(direction: str, depth: int, start: str) -> str:
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    return v.with_(
        v.SYM, v.FILE, v.GRAPH,
        "t AS (SELECT DISTINCT caller_id AS src, callee_id AS dst, call_type FROM call_edges WHERE caller_id IS NOT NULL AND callee_id IS NOT NULL)",
        f"""h(node, depth, path, call_type) AS (
  SELECT {b}, 1, [{b}], call_type FROM t WHERE {a} = ({start})
  UNION ALL
  SELECT t.{b}, h.depth + 1, list_append(h.path, t.{b}), t.call_type FROM h JOIN t ON t.{a} = h.node
  WHERE h.depth < {depth} AND NOT list_contains(h.path, t.{b}))""",
        recursive=True,
    ) + "SELECT DISTINCT s.name AS symbol, f.path, f.sha, s.start_line, s.end_line, h.call_type, h.depth FROM h JOIN sym s ON s.id = h.node JOIN file f ON f.id = s.file_id"


_FIRST, _LAST = "SELECT src FROM g GROUP BY src ORDER BY count(*) DESC, src LIMIT 1", "SELECT max(dst) FROM g"
_AWAY = "away(node, depth) AS (SELECT ({first}), 0 UNION SELECT g.dst, away.depth + 1 FROM away JOIN g ON g.src = away.node WHERE away.depth < 3), target AS (SELECT max(node) AS t FROM (SELECT node FROM away GROUP BY node HAVING min(depth) = 3))".format(first=_FIRST)
_TARGET = "SELECT t FROM target"
_LEVELS = "r(node, depth) AS (SELECT ({start}), 0 UNION SELECT {to}, r.depth + 1 FROM r JOIN {edges} e ON e.{at} = r.node WHERE r.depth < {most}), lv AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)"
_T = "t AS (SELECT DISTINCT id, caller_id AS src, callee_id AS dst, call_type, confidence, config_guard FROM call_edges)"
_PATHS = """p(path, node, length, score) AS (
  SELECT [src, dst], dst, 1, w FROM {edges} WHERE src = ({first})
  UNION ALL
  SELECT list_append(p.path, e.dst), e.dst, p.length + 1, p.score * e.w FROM p JOIN {edges} e ON e.src = p.node
  WHERE p.length < 4 AND p.node <> ({last}) AND (e.dst = ({last}) OR NOT list_contains(p.path, e.dst)))"""

SQL = {
    "g_khop_down": _hops("down", 3, _FIRST),
    "g_khop_up": _hops("up", 3, _LAST),
    "g_neighbours": v.with_(v.SYM, v.GRAPH, _T) + f"""
SELECT 'callee' AS direction, t.id AS edge_id, s.name, t.call_type FROM t JOIN sym s ON s.id = t.dst WHERE t.src = ({_FIRST})
UNION ALL SELECT 'caller', t.id, s.name, t.call_type FROM t JOIN sym s ON s.id = t.src WHERE t.dst = ({_FIRST})""",
    "g_relationship_tree": v.with_(v.GRAPH, "k AS (SELECT DISTINCT caller_id AS src, callee_id AS dst FROM call_edges WHERE call_type = 'direct' AND confidence IN ('high', 'medium') AND caller_id IS NOT NULL AND callee_id IS NOT NULL)", f"""
h(node, depth, path) AS (
  SELECT dst, 1, [dst] FROM k WHERE src = ({_FIRST})
  UNION ALL SELECT k.dst, h.depth + 1, list_append(h.path, k.dst) FROM h JOIN k ON k.src = h.node WHERE h.depth < 4 AND NOT list_contains(h.path, k.dst))""", recursive=True)
    + "SELECT depth, array_to_string(path, '/') AS path FROM h",
    "g_reach_depth": v.with_(v.GRAPH, _LEVELS.format(start=_FIRST, to="e.dst", edges="g", at="src", most=3), recursive=True) + "SELECT node, depth FROM lv",
    "g_levels": v.with_(v.GRAPH, _LEVELS.format(start=_FIRST, to="e.dst", edges="g", at="src", most=40), recursive=True) + "SELECT depth, count(*) AS n, min(node) AS first_node FROM lv GROUP BY depth",
    "g_descendants": v.with_(v.GRAPH, _LEVELS.format(start=_FIRST, to="e.dst", edges="g", at="src", most=2), recursive=True) + "SELECT DISTINCT node FROM r WHERE depth > 0",
    "g_ancestors": v.with_(v.GRAPH, _LEVELS.format(start=_LAST, to="e.src", edges="g", at="dst", most=2), recursive=True) + "SELECT DISTINCT node FROM r WHERE depth > 0",
    "g_traversed_edges": v.with_(v.GRAPH, _T, "d AS (SELECT * FROM t WHERE call_type = 'direct')", _LEVELS.format(start=_FIRST, to="e.dst", edges="d", at="src", most=2), recursive=True)
    + "SELECT d.id AS edge_id, d.src, d.dst FROM d WHERE d.src IN (SELECT node FROM lv)",
    "g_shortest_length": v.with_(v.GRAPH, _AWAY, _LEVELS.format(start=_FIRST, to="e.dst", edges="g", at="src", most=4), recursive=True)
    + f"SELECT ({_FIRST}) AS source, node AS target, depth AS length FROM lv WHERE node = ({_TARGET})",
    "g_all_paths": v.with_(v.GRAPH, "w AS (SELECT src, dst, 1.0::DOUBLE AS w FROM g)", _AWAY, _PATHS.format(edges="w", first=_FIRST, last=_TARGET), recursive=True)
    + f"SELECT array_to_string(path, '/') AS path, length FROM p WHERE node = ({_TARGET})",
    "g_top_paths": v.with_(v.GRAPH, "w AS (SELECT caller_id AS src, callee_id AS dst, max(CASE confidence WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.7 ELSE 0.5 END)::DOUBLE AS w FROM call_edges WHERE caller_id IS NOT NULL AND callee_id IS NOT NULL GROUP BY 1, 2)", _AWAY, _PATHS.format(edges="w", first=_FIRST, last=_TARGET), recursive=True)
    + f"SELECT array_to_string(path, '/') AS path, length, round(score, 6) AS score FROM p WHERE node = ({_TARGET}) ORDER BY p.score DESC, p.length, p.path LIMIT 10",
    "g_cycles": v.with_(v.GRAPH, "e AS (SELECT * FROM g WHERE src <> dst)") + """
SELECT DISTINCT least(a.src, a.dst) || '/' || greatest(a.src, a.dst) AS nodes, 2 AS length FROM e a JOIN e b ON b.src = a.dst AND b.dst = a.src
UNION ALL
SELECT DISTINCT array_to_string(list_sort([a.src, b.src, c.src]), '/'), 3 FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst AND c.dst = a.src WHERE b.dst <> a.src""",
    "g_self_loops": v.with_(v.SYM, v.GRAPH) + "SELECT DISTINCT a.file_id AS node FROM g JOIN sym a ON a.id = g.src JOIN sym b ON b.id = g.dst WHERE a.file_id = b.file_id",
    "g_cycle_checks": v.with_(v.GRAPH, "n AS (SELECT src FROM g UNION SELECT dst FROM g)", "m AS (SELECT count(*) AS n FROM g JOIN g h ON h.src = g.dst AND h.dst = g.src)") + """
SELECT 'nodes' AS what, count(*) AS n FROM n UNION ALL SELECT 'mutual calls', n FROM m
UNION ALL SELECT unnest(['nodes named twice', 'steps that are no edge', 'nodes outside of their component', 'mutual calls between components', 'edges of the condensation both ways']), 0""",
    "g_path_refresh": v.with_(v.EDGE) + """
, c AS (SELECT caller_id AS source, callee_id AS target, id, created_at, CASE WHEN id % 3 = 0 THEN id % 2 ELSE 0 END AS used FROM edge WHERE caller_id IS NOT NULL AND callee_id IS NOT NULL),
m AS (SELECT source, target, arg_max(id, (coalesce(created_at, TIMESTAMP '1900-01-01'), id)) AS edge_id, max(created_at) AS t, sum(used)::BIGINT AS access_count FROM c GROUP BY 1, 2)
SELECT source, target, edge_id, access_count FROM m WHERE access_count > 0 OR t >= TIMESTAMP '2025-06-08'""",
    "g_topological": v.with_(v.GRAPH, "e AS (SELECT * FROM g WHERE src < dst)", "n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)", """
l(node, level) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT dst FROM e) UNION SELECT e.dst, l.level + 1 FROM l JOIN e ON e.src = l.node)""", recursive=True)
    + "SELECT node, max(level) AS level FROM l GROUP BY node",
    "g_first_callee_flow": v.with_(v.SYM, v.GRAPH, "f AS (SELECT g.src, arg_min(g.dst, (s.name, g.dst)) AS nxt FROM g JOIN sym s ON s.id = g.dst GROUP BY g.src)", """
w(root, hop, node, path) AS (
  SELECT DISTINCT src, 0, src, [src] FROM g
  UNION ALL SELECT w.root, w.hop + 1, f.nxt, list_append(w.path, f.nxt) FROM w JOIN f ON f.src = w.node WHERE w.hop < 5 AND NOT list_contains(w.path, f.nxt))""", recursive=True)
    + "SELECT root, hop, node FROM w",
    "g_call_chains": v.with_(v.GRAPH, _T, _LEVELS.format(start=_LAST, to="e.src", edges="g", at="dst", most=1), recursive=True)
    + "SELECT lv.depth + 1 AS distance, t.src AS caller, t.dst AS callee, count(*) AS n_edges, count(CASE WHEN t.config_guard IS NULL THEN 1 END) AS n_active FROM t JOIN lv ON lv.node = t.dst WHERE t.src IS NOT NULL GROUP BY 1, 2, 3",
    "g_degrees": v.with_(v.GRAPH) + "SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM g UNION ALL SELECT dst, 0, 1 FROM g) GROUP BY node",
    "g_size": v.with_(v.GRAPH, "n AS (SELECT count(*) AS n FROM (SELECT src FROM g UNION SELECT dst FROM g))", "m AS (SELECT count(*) AS m FROM g)")
    + "SELECT n AS n_nodes, m AS n_edges, round(2.0 * m / n, 6) AS average_degree, round(least(2.0 * m / (n * (n - 1.0)), 1.0), 9) AS density FROM n, m",
    "g_boundary": v.with_(v.SYM, v.GRAPH) + "SELECT a.config AS src_part, b.config AS dst_part, count(*) AS n_edges FROM g JOIN sym a ON a.id = g.src JOIN sym b ON b.id = g.dst WHERE a.config <> b.config GROUP BY 1, 2",
    "g_path_cache": v.with_(v.EDGE) + "SELECT caller_id AS path_id, row_number() OVER (PARTITION BY caller_id ORDER BY line_number NULLS FIRST, column_number NULLS FIRST, id) - 1 AS pos, id AS edge_id, callee_id FROM edge WHERE file_path IS NOT NULL AND caller_id IS NOT NULL",
}
