"""Splitting oversized texts at natural boundaries.

Every position of a text has a boundary strength. For each piece the strongest
cut within the permissible lengths is looked up in a sparse table of range
maxima whose entries hold strength and position, so that ties go to the right;
the next piece then steps back by the overlap. The table covers a slab of the
text at a time, so memory doesn't follow the text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Strengths. Up to LINE_END a cut lies at a line end, up to WORD_END between words.
PARAGRAPH, LINE_START, LINE_END, WORD_START, WORD_END, INSIDE = 5, 4, 3, 2, 1, 0
_SLAB = 1 << 15


def strengths(text: str) -> np.ndarray:
    """The strength of a cut before each position 0..len(text)."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    out = np.zeros(n + 1, np.int8)
    lf, cr = code == 10, code == 13
    blank = lf | cr | (code == 32) | (code == 9)
    before, after = blank[:-1], blank[1:]
    out[1:n][before & ~after] = WORD_START
    out[1:n][~before & after] = WORD_END
    out[1:n][before & after] = WORD_START
    out[:n][lf] = LINE_END
    crlf = cr[:-1] & lf[1:]
    out[:-2][crlf] = LINE_END
    out[1:][lf] = LINE_START
    out[1:n][crlf] = INSIDE  # between the two characters of a line end
    ends = np.flatnonzero(lf)
    if len(ends) > 1:
        gap = np.diff(ends)
        empty = (gap == 1) | ((gap == 2) & cr[ends[1:] - 1])
        out[ends[1:][empty] + 1] = PARAGRAPH
    out[0] = out[n] = PARAGRAPH
    return out


class RangeMaximum:
    """The strongest position of a range, the rightmost of equals.

    Windows may be at most ``width`` long.
    """

    def __init__(self, strength: np.ndarray, width: int) -> None:
        self.strength, self.width = strength, width
        self.base, self.levels = 0, []  # type: int, list[np.ndarray]

    def _load(self, base: int) -> None:
        part = self.strength[base : base + _SLAB + 2 * self.width].astype(np.int64)
        level = (part << 40) + np.arange(base, base + len(part))
        self.base, self.levels, step = base, [level], 1
        while 2 * step <= min(self.width + 1, len(part)):
            level = np.maximum(level[:-step], level[step:])
            self.levels.append(level)
            step *= 2

    def query(self, low: int, high: int) -> tuple[int, int]:
        """Strength and position of the best cut in low..high, both included."""
        if not self.levels or low < self.base or high >= self.base + len(self.levels[0]):
            self._load(low)
        k = (high - low + 1).bit_length() - 1
        level = self.levels[k]
        best = max(level[low - self.base], level[high - (1 << k) + 1 - self.base])
        return int(best >> 40), int(best & ((1 << 40) - 1))


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut at the end) of each piece.

    No piece is longer than ``limit``. A piece starts at most ``overlap``
    characters before the end of the one before it and ends behind it. An empty
    text has no pieces, a text within the limit one. Cuts are at line ends
    wherever no line is too long; else between words wherever no word is too
    long: the overlap is shortened rather than a line or word broken.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap below it")
    n = len(text)
    if n == 0:
        return []
    if n <= limit:
        return [(0, n, PARAGRAPH)]
    strength = strengths(text)
    index = RangeMaximum(strength, limit + 1)
    pieces: list[tuple[int, int, int]] = []
    start, done = 0, 0
    while True:
        if n - start <= limit:
            pieces.append((start, n, PARAGRAPH))
            return pieces
        low = max(done + 1, start + limit // 2)
        best, cut = index.query(low, start + limit)
        if best < LINE_END:
            best, cut = index.query(done + 1, start + limit)
        pieces.append((start, cut, best))
        done = cut
        if n - done <= limit - overlap and n - done <= limit:
            reach = n
        else:
            # the strongest cut that the next piece could have without overlap
            top, _ = index.query(done + 1, min(done + limit, n))
            ahead = strength[done + 1 : min(done + limit, n) + 1]
            level = LINE_END if top >= LINE_END else WORD_END if top >= WORD_END else INSIDE
            reach = done + 1 + int(np.argmax(ahead >= level))
        earliest = max(done - overlap, reach - limit, start + 1, 0)
        start = done
        if earliest < done:
            # step back: the leftmost of the strongest starts within the overlap
            window = strength[earliest:done]
            kind = np.where(window >= LINE_START, 2, np.where(window == WORD_START, 1, 0))
            start = earliest + int(np.argmax(kind))


def cut_kind(pieces: list[tuple[int, int, int]]) -> str:
    """``line``, ``word`` or ``none``: the weakest boundary that was cut."""
    weakest = min((s for *_, s in pieces), default=PARAGRAPH)
    return "line" if weakest >= LINE_END else "word" if weakest >= WORD_END else "none"


_PIECES = "content_id long, chunk_index int, char_start long, char_end long, cut_kind string, chunk_text string"


def split_items(df: DataFrame, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    """``content_id, chunk_index, char_start, char_end, cut_kind, chunk_text``.

    One row per piece, numbered from 0 within an item; positions count code
    points. cut_kind is the weakest boundary used anywhere in the item. Null and
    empty texts give no rows, a null key is kept. Rows with the same key are
    split one by one. Other columns aren't read, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for k, t in zip(batch["k"], batch["t"]):
                pieces = split(t, limit, overlap) if t else []
                kind = cut_kind(pieces)
                rows += [(k, i, a, b, kind, t[a:b]) for i, (a, b, _) in enumerate(pieces)]
                if len(rows) > 4000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, _PIECES)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["content_id", "chunk_index", "char_start", "char_end", "cut_kind", "chunk_text"])
    out["content_id"] = out["content_id"].astype("Int64")
    return out


def oversized(df: DataFrame, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    """``content_id, cut_kind`` of the items longer than ``limit``, from their pieces."""
    pieces = split_items(df.filter(F.length(text) > limit), key, text, limit, overlap)
    return pieces.filter(F.col("chunk_index") == 0).select("content_id", "cut_kind")
