"""Mixing: budgets by hand, shares and repeats on random records."""

from __future__ import annotations

import numpy as np
import pytest

from corvine.llm import mixing as m


def test_fill_redistributes_by_weight():
    assert m.fill([(1, 100), (1, 10), (2, 100)], 100) == pytest.approx([30, 10, 60])
    assert m.fill([(1, 5), (1, 5)], 100) == [5, 5]
    assert m.fill([(0, 50), (1, 10)], 30) == [20, 10]
    assert m.fill([], 10) == []


def test_siblings_come_before_ancestors():
    root = m.Node()
    root.add(("a", "en", "x"), 0.25, 10)
    root.add(("a", "en", "y"), 0.25, 1000)
    root.add(("b", "en", "z"), 0.5, 1000)
    assert m.budgets(root, 100) == pytest.approx({("a", "en", "x"): 10, ("a", "en", "y"): 40, ("b", "en", "z"): 50})
    root.children["a"].children["en"].children["y"].capacity = 20
    for node in (root.children["a"].children["en"], root.children["a"]):
        node.capacity = 30
    root.capacity = 1030
    assert m.budgets(root, 100) == pytest.approx({("a", "en", "x"): 10, ("a", "en", "y"): 20, ("b", "en", "z"): 70})


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(6000):
        source = ["big", "Big ", " mid", "small", None, "unknown"][min(5, int(rng.exponential(1.2)))]
        rows.append((i, source, ["en", "DE", "de-x", None, "??"][i % 5], int(rng.integers(0, 60)), "clash"))
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens long, copies string")
    targets = {"big": (0.5, 1), "mid": (0.2, 2), "small": (0.25, 3), "gone": (0.05, 4)}
    chosen, report = m.mix(df, "doc_id", "source", "lang", "n_tokens", targets, {"big": "a", "mid": "a", "small": "b"}, ["en", "de"])
    by = {r.source: r for r in report.collect()}
    assert set(by) == set(targets) and by["gone"].used_tokens == 0
    assert sum(r.actual_share for r in by.values()) == pytest.approx(1)
    picked = chosen.collect()
    assert len({r.doc_id for r in picked}) == len(picked)
    for r in picked:
        assert 1 <= r.copies <= targets[r.source][1] and r.language in ("en", "de", "und") and r.n_tokens > 0
    for s, r in by.items():
        assert r.used_tokens == sum(p.n_tokens * p.copies for p in picked if p.source == s)
    total = sum(r.available_tokens for r in by.values())
    assert sum(r.used_tokens for r in by.values()) == pytest.approx(total, abs=60 * 9)
    again = m.mix(df.repartition(7), "doc_id", "source", "lang", "n_tokens", targets, {"big": "a", "mid": "a", "small": "b"}, ["en", "de"])[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, picked))


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_tokens long")
    chosen, report = m.mix(df, "doc_id", "source", "lang", "n_tokens", {"big": (1.0, 1)}, {}, [])
    assert chosen.count() == 0 and report.first().actual_share == 0


def test_the_prefix_ends_where_the_order_says(spark):
    """Against the sorted order in plain Python, keys that repeat included."""
    from pyspark.sql import functions as F

    rows = [(i % 400, "a", "en", 1 + i % 7) for i in range(500)] + [(1000 + i, "b", "en", 5) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n long")
    targets = {"a": (0.3, 1), "b": (0.7, 1)}
    chosen, report = m.mix(df, "doc_id", "source", "lang", "n", targets, {}, ["en"], seed=3)
    place = dict(df.select("doc_id", F.xxhash64(F.lit(3), F.lit(0), "doc_id")).collect())
    have = {s: sum(r[3] for r in rows if r[1] == s) for s in "ab"}
    plan = {leaf[2]: leaf for leaf in m.plan([("other", "en", s, have[s]) for s in "ab"], targets)}
    got = {}
    for r in chosen.collect():
        got[r.source] = got.get(r.source, 0) + r.n_tokens * r.copies
    for s in "ab":
        _, _, _, whole, rest = plan[s]
        used = 0
        for _, _, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: (place[r[0]], r[0])):
            if whole == 0 and used + n / 2 <= rest:
                used += n
            elif whole == 0:
                break
        assert got[s] == (have[s] if whole else 0) + used or abs(got[s] - rest - whole * have[s]) <= 7
    assert report.count() == 2
