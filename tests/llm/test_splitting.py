"""Splitting: limits, coverage, overlap and boundaries, against brute force."""

from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from corvine.llm import splitting as s


def kind_by_rule(text: str, limit: int) -> str:
    lines = re.split(r"\r?\n", text)
    if max(map(len, lines)) <= limit:
        return "line"
    return "word" if max(map(len, re.split(r"[ \t\r\n]+", text))) <= limit else "none"


def check(text: str, limit: int, overlap: int) -> None:
    pieces = s.split(text, limit, overlap)
    if not text:
        assert pieces == []
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b, _ in pieces:
        assert 0 < b - a <= limit
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert a < c <= b and b - c <= overlap and d > b
    if len(text) > limit:
        assert s.cut_kind(pieces) == kind_by_rule(text, limit)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab \n\r\tü字", max_size=120), st.integers(3, 25), st.integers(0, 2))
def test_random(text, limit, overlap):
    check(text, limit, overlap)


def test_long_text_crosses_slabs():
    text = "\n".join(" ".join(["word%d" % i] * (i % 90)) for i in range(3000))
    check(text, 2000, 200)
    check("x" * 150_000, 2000, 200)


def test_range_maximum_breaks_ties_to_the_right():
    import numpy as np

    index = s.RangeMaximum(np.array([1, 3, 0, 3, 2], np.int8), 5)
    assert index.query(0, 4) == (3, 3)
    assert index.query(0, 2) == (3, 1)


def test_frame(spark):
    rows = [(1, "x" * 3000, "clash"), (2, "", None), (3, None, None), (None, "short", None), (4, "a b\n" * 400_000, None), (5, "ok", None), (5, "ok", None)]
    df = spark.createDataFrame(rows, "id long, content string, chunk_index string")
    got = s.split_items(df, "id", "content", 2000, 200)
    n = {r.content_id: r["count"] for r in got.groupBy("content_id").count().collect()}
    assert n.pop(4) > 800 and n == {1: 2, None: 1, 5: 2}
    pieces = got.filter("content_id = 1").orderBy("chunk_index").collect()
    assert [(r.char_start, r.char_end, r.cut_kind) for r in pieces] == [(0, 2000, "none"), (1800, 3000, "none")]
    assert {(r.content_id, r.cut_kind) for r in s.oversized(df, "id", "content", 2000, 200).collect()} == {(1, "none"), (4, "line")}
    assert s.split_items(df.limit(0), "id", "content", 2000, 200).count() == 0


def test_parameters_are_checked():
    import pytest

    for limit, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            s.split("text", limit, overlap)
