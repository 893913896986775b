"""Packing: nothing lost, nothing over capacity, little room left; against a plain version."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corvine.llm import packing


def plain(sizes, capacity):
    """The rule read literally: try every level."""
    counts, boxes, out, opened = {}, {}, [], 0
    for s in sizes:
        best = None
        for h in range(capacity - s, -1, -1):
            if h and not counts.get(h):
                continue
            c = dict(counts)
            if h:
                c[h] -= 1
            if h + s < capacity:
                c[h + s] = c.get(h + s, 0) + 1
            score = sum(v * v for v in c.values())
            if best is None or score < best[0]:
                best = (score, h, c)
        _, h, counts = best
        box = boxes[h].pop() if h else opened
        opened += not h
        boxes.setdefault(h + s, []).append(box)
        out.append(box)
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 14).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=40))))
def test_same_as_the_plain_rule(case):
    capacity, sizes = case
    assert packing.sum_of_squares(np.array(sizes, np.int64), capacity).tolist() == plain(sizes, capacity)


def test_pack(spark):
    rng = np.random.default_rng(1)
    sizes = [None, 0, 5000, 512, 1024] + rng.integers(1, 700, 2500).tolist()
    rows = [(i, s, "x") for i, s in enumerate(sizes)] + [(7, 3, "y"), (7, 3, "y")]
    df = spark.createDataFrame(rows, "doc_id long, size int, capacity string")
    got = packing.pack(df, "doc_id", "size", {"small": 512, "big": 2048}, shard=300).collect()
    for name, capacity in (("small", 512), ("big", 2048)):
        mine = [r for r in got if r.limit_name == name]
        assert sum(r.n_tokens for r in mine) == sum(s or 0 for _, s, _ in rows)
        fill = {}
        for r in mine:
            if r.container_id is None:
                assert r.n_tokens == 0
            else:
                fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        assert max(fill.values()) <= capacity
        assert len(fill) <= 1.06 * sum(fill.values()) / capacity + 1
        pieces = {}
        for r in mine:
            pieces.setdefault(r.doc_id, []).append(r)
        assert set(pieces) == set(range(len(sizes)))
        for k, rs in pieces.items():
            if k != 7 and (sizes[k] or 0) <= capacity:
                assert len(rs) == 1
        big = sorted(pieces[2], key=lambda r: r.piece)
        assert [r.token_start for r in big] == [i * capacity for i in range(len(big))]
    assert packing.pack(df.limit(0), "doc_id", "size", {"small": 512}).count() == 0
    assert packing.summary(packing.pack(df, "doc_id", "size", {"small": 512})).first().fill > 0.9


def test_tokens(spark):
    from corvine.llm import tokens

    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "ä" * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.sizes(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1000


def test_a_key_that_a_third_of_the_rows_repeat_is_spread(spark):
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, 1 + i % 50) for i in range(900)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, n long"), "doc_id", "n", {"box": 100}, shard=100).collect()
    assert len(packed) == 900 and sum(r.n_tokens for r in packed) == sum(n for _, n in rows)
    fill = {}
    for r in packed:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert max(fill.values()) <= 100 and len(fill) <= 1.1 * sum(n for _, n in rows) / 100
