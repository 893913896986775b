"""Graph operators on literal graphs and against plain Python on random ones."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from corvine.operators import graph as g


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "x") for a, b in pairs], "src long, dst long, node string")


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


TREE = [(1, 2), (2, 3), (1, 4), (4, 5)]


def test_tree(spark):
    e = edges(spark, TREE + [(None, 3), (3, None), (1, 2)])
    got = {r.node: r.depth for r in g.levels(e, nodes(spark, 1)).collect()}
    assert got == {1: 0, 2: 1, 4: 1, 3: 2, 5: 2}
    assert {r.node for r in g.levels(e, nodes(spark, 1), 1).collect()} == {1, 2, 4}
    assert {r.node for r in g.ancestors(e, nodes(spark, 3)).collect()} == {1, 2}
    assert {r.node for r in g.descendants(e, nodes(spark, 1), 0).collect()} == {2, 4}
    assert [r.node for r in g.shortest_path(e, 1, 5).orderBy("pos").collect()] == [1, 4, 5]
    assert g.shortest_path(e, 5, 1).count() == 0
    assert g.bidirectional_distance(e, 1, 5).first().length == 2
    level = {r.node: r.level for r in g.topological_levels(e).collect()}
    assert level == {1: 0, 2: 1, 4: 1, 3: 2, 5: 2}
    assert [r.node for r in g.visit_order(e, 1).orderBy("pos").collect()] == [1, 2, 3, 4, 5]
    chains = {(r.caller, r.distance): r.chain for r in g.call_chains(e.filter("dst IS NOT NULL"), nodes(spark, 3), 10).filter("caller IS NOT NULL").collect()}
    assert chains == {(2, 1): [3, 2], (1, 2): [3, 2, 1]}


def test_cycles(spark):
    ring = edges(spark, [(1, 2), (2, 3), (3, 1), (4, 4), (5, 6)])
    comp = {r.node: r.component for r in g.components(ring).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    assert [(r.component, r.n_nodes, r.self_loop) for r in g.cycle_summary(ring).collect()] == [(1, 3, False), (4, 1, True)]
    assert [(r.nodes, r.length) for r in g.cycles_up_to(ring, 4).collect()] == [([1, 2, 3], 3)]
    assert {r.node for r in g.topological_levels(ring).filter("level IS NULL").collect()} == {1, 2, 3, 4}
    # the start comes back through the cycle, once
    assert sorted((r.depth, r.node) for r in g.neighbourhood(ring, nodes(spark, 1), 5).collect()) == [(1, 2), (2, 3), (3, 1)]
    assert {r.node for r in g.descendants(ring, nodes(spark, 1)).collect()} == {1, 2, 3}
    assert sorted(map(tuple, (r.path for r in g.all_paths(ring, 1, 1, 3).collect()))) == [(1, 2, 3, 1)]
    assert g.condensation(ring, g.components(ring)).count() == 1


def test_no_depth_is_cut(spark):
    line = edges(spark, [(i, i + 1) for i in range(1, 12)])
    got = g.neighbourhood(line, nodes(spark, 1), 8).collect()
    assert sorted(r.depth for r in got) == list(range(1, 9)) and max(len(r.path) for r in got) == 8
    assert [r.node for r in g.shortest_path(line, 1, 12).orderBy("pos").collect()] == list(range(1, 13))
    assert g.bidirectional_distance(line, 1, 12).first().length == 11 and g.bidirectional_distance(line, 12, 1).count() == 0
    assert g.bidirectional_distance(line, 3, 3).first().length == 0
    assert g.all_paths(line, 1, 12, 10).count() == 0 and g.all_paths(line, 1, 12, 11).count() == 1
    assert g.neighbourhood(line, nodes(spark, 99), 3).count() == 0 and g.neighbourhood(line, nodes(spark, 1), 0).count() == 0


def test_witness_cycles_and_their_edges(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (1, 4), (4, 1), (5, 5), (6, 7), (8, 9), (9, 10), (10, 8), (10, 11)])
    comps = g.components(e)
    got = {}
    for r in g.witness_cycles(e, comps).collect():
        got.setdefault(r.component, {})[r.pos] = r.node
    assert {c: [p[i] for i in sorted(p)] for c, p in got.items()} == {1: [1, 4], 5: [5], 8: [8, 9, 10]}
    assert {(r.src, r.dst) for r in g.cycle_edges(e, comps).collect()} == {(1, 2), (2, 3), (3, 1), (1, 4), (4, 1), (5, 5), (8, 9), (9, 10), (10, 8)}


def test_path_cache(spark):
    kind = "source long, target long, edge_ids array<long>, computed_at timestamp, access_count long"
    from datetime import datetime

    t = lambda d: datetime(2025, 6, d)
    old = spark.createDataFrame([(1, 2, [1], t(1), 3), (1, 3, [2], t(1), 0), (1, 4, [3], t(1), 0), (None, 1, [], t(1), 9)], kind)
    new = spark.createDataFrame([(1, 2, [4, 5], t(20), 0), (1, 4, [6], t(19), 0), (1, 4, [6], t(19), 0)], kind)
    got = {(r.source, r.target): (r.edge_ids, r.access_count) for r in g.refresh_paths(old, new, "2025-06-21 00:00:00", 7).collect()}
    assert got == {(1, 2): ([4, 5], 3), (1, 4): ([6], 0)}


def test_empty(spark):
    e = edges(spark, [])
    assert g.components(e).count() == 0 and g.topological_levels(e).count() == 0 and g.degrees(e).count() == 0
    assert g.levels(e, nodes(spark, 1)).count() == 1
    assert g.size_statistics(e).first().average_degree == 0


def strong(pairs):
    reach = {}
    for a in {x for p in pairs for x in p}:
        seen, todo = {a}, deque([a])
        while todo:
            n = todo.popleft()
            for x, y in pairs:
                if x == n and y not in seen:
                    seen.add(y)
                    todo.append(y)
        reach[a] = seen
    return {a: min(b for b in reach[a] if a in reach[b]) for a in reach}


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_of_random_graphs(spark, seed, monkeypatch):
    from corvine.plans import graph_queries as q

    rng = random.Random(seed)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(34)] + [(40, 40), (50, 51), (51, 50)]
    comp = strong(pairs)
    above = {c: {comp[a] for a, b in pairs if comp[b] == c != comp[a]} for c in comp.values()}
    depth = lambda c: max((depth(a) + 1 for a in above[c]), default=0)
    # a node is open if its component or one above it holds a cycle
    cyclic = {comp[a] for a, b in pairs if comp[a] == comp[b]}
    behind = lambda c: c in cyclic or any(behind(a) for a in above[c])
    monkeypatch.setattr(q.v, "graph", lambda spark, base: edges(spark, pairs))
    whole = {r.node: (r.component, r.level) for r in q.QUERIES["g_topological_components"](spark, "").collect()}
    assert whole == {n: (c, depth(c)) for n, c in comp.items()}
    peeled = {r.node: r.level for r in q.QUERIES["g_topological_cycles"](spark, "").collect()}
    assert peeled == {n: None if behind(c) else depth(c) for n, c in comp.items()}
    assert None in peeled.values() and any(peeled.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(16), rng.randrange(16)) for _ in range(24)]
    assert {r.node: r.component for r in g.components(edges(spark, pairs)).collect()} == strong(pairs)


def test_path_is_valid(spark):
    df = spark.sql("SELECT id, hops FROM VALUES (1, array(named_struct('src',1,'dst',2), named_struct('src',2,'dst',3))), (2, array(named_struct('src',1,'dst',2), named_struct('src',3,'dst',3))), (3, array(named_struct('src',1,'dst',2))), (4, slice(array(named_struct('src',1,'dst',2)), 1, 0)) t(id, hops)")
    assert {r.id: r.ok for r in df.select("id", g.path_is_valid(F.col("hops")).alias("ok")).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_top_paths(spark):
    df = spark.createDataFrame([(1, 2, 0.9), (2, 4, 0.9), (1, 3, 0.5), (3, 4, 0.9), (1, 4, 0.7)], "src long, dst long, w double")
    got = g.top_paths(df, 1, 4, 3, 2, "w").collect()
    assert [r.path for r in got] == [[1, 2, 4], [1, 4]] and got[0].score == pytest.approx(0.81)
