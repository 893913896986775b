"""Most similar vectors by score-aware quantisation.

Unit vectors are placed in cells on two levels: coarse cells (spherical k-means)
and, once these would hold too many vectors, finer ones around shared residual
centres, so the number of cells grows with the collection. Residuals of a vector
along its own direction harm inner products more than those across it, so the
product codebooks - 16 words, four bits, for every two components - are fitted
and codes are chosen under a loss that weighs the parallel part higher. A query
visits cells, adds up table entries for the codes there, two codes a byte, and
only what the tables let through is compared exactly.

Two kinds of search differ in what they visit. ``neighbours`` visits the best
cells of each query, as many as held-out queries need for the wanted recall.
``similar_pairs`` visits every cell whose border is nearer than two similar
vectors can be apart across it, and lets through whatever the known residual of
a code could lift to the wanted cosine; only the first may lose a pair, with a
stated probability, and not at all if asked for.

Cells and codebooks are fitted on a bounded sample; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvine.session import checkpoint_dir

SAMPLE = 65_536  # vectors that the index is fitted on, at most
COARSE = 2_048  # coarse cells at most; their centres are sent to every task
FINE = 256  # finer cells of each at most
BLOCK = 32_768  # vectors of a cell that one table scan covers
SIGMAS = 4.5  # of the distance of two similar vectors across a border; 3 in a million are further apart
HELD_OUT = 1_000  # sampled vectors that aren't fitted on but measure the recall
THRESHOLD = 0.2  # T of the score-aware loss: scores below it don't matter
WORDS = 16
_SLACK = 1e-5  # of single precision


@dataclass
class Index:
    """What a task needs: centres of both levels, codebooks, blocks per cell, cells to visit."""

    centres: np.ndarray  # coarse x dim, unit vectors
    fine: np.ndarray  # fine x dim, residual centres
    codebooks: np.ndarray  # dim/2 x 16 x 2
    blocks: np.ndarray  # per cell
    eta: float
    probes: int  # cells that a query visits for the wanted recall

    def __post_init__(self) -> None:
        # x lies nearer to the fine centre with the greater x.s - shift
        self.shift = self.centres @ self.fine.T + (self.fine**2).sum(1) / 2
        self.apart = np.sqrt(np.maximum(((self.fine[:, None] - self.fine[None]) ** 2).sum(2), 0))
        self.apart_coarse = np.sqrt(np.maximum(2 - 2 * self.centres @ self.centres.T, 0))

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector: the nearest coarse centre, then the nearest fine one there."""
        coarse = _nearest(x, self.centres, 1)[:, 0]
        return coarse * len(self.fine) + (x @ self.fine.T - self.shift[coarse]).argmax(1)

    def best(self, x: np.ndarray, m: int) -> np.ndarray:
        """The m cells whose centres are nearest to each vector, the best first."""
        f = len(self.fine)
        score = (x @ self.centres.T)[:, :, None] + (x @ self.fine.T)[:, None, :] - self.shift[None]
        return _top(score.reshape(len(x), len(self.centres) * f), m)

    def within(self, x: np.ndarray, home: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): every other cell that can hold a vector within ``reach`` of the row's, of two cells one.

        A vector of another cell lies behind the plane half-way between the two
        centres, so the distance to that plane is a bound. It is taken between
        coarse cells first, then between the fine cells of those that are left.
        Of two cells the greater is visited if their sum is even, else the
        smaller, so visits are spread evenly.
        """
        f = len(self.fine)
        s = x @ self.centres.T
        top = home // f
        gap = s[np.arange(len(x)), top][:, None] - s
        row, coarse = np.nonzero(gap <= reach * self.apart_coarse[top] + _SLACK)
        if f == 1:
            keep = _one_way(home[row], coarse)
            return row[keep], coarse[keep]
        at = (x @ self.fine.T)[row] - self.shift[coarse]
        own = at.argmax(1)
        near = at[np.arange(len(row)), own][:, None] - at <= reach * self.apart[own] + _SLACK
        pair, fine = np.nonzero(near)
        cell = coarse[pair] * f + fine
        keep = _one_way(home[row[pair]], cell)
        return row[pair][keep], cell[keep]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Two four-bit codes a byte."""
        code = _assign(x, self.codebooks, self.eta)
        return (code[:, 0::2] | code[:, 1::2] << 4).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        code = np.empty((len(codes), 2 * codes.shape[1]), np.uint8)
        code[:, 0::2], code[:, 1::2] = codes & 15, codes >> 4
        return self.codebooks[np.arange(code.shape[1]), code].reshape(len(codes), -1)

    def lift(self, x: np.ndarray, codes: np.ndarray, least: float) -> np.ndarray:
        """How much the true score of a vector at least ``least`` similar may be above the table's.

        The residual's part along x counts whole, the part across it only by the
        sine of the angle; the score-aware codes keep the first part small.
        """
        r = x - self.decode(codes)
        along = (r * x).sum(1)
        across = np.sqrt(np.maximum((r**2).sum(1) - along**2, 0))
        return np.abs(along) + np.sqrt(max(1 - least**2, 0)) * across + _SLACK

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query, the scores of every byte: queries x (dim/4 * 256)."""
        m = self.codebooks.shape[0]
        one = np.einsum("nmd,mwd->nmw", q.reshape(len(q), m, -1), self.codebooks)
        return (one[:, 0::2, None, :] + one[:, 1::2, :, None]).reshape(len(q), -1).astype(np.float32)

    def scan(self, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate scores: queries x vectors."""
        at = (codes.astype(np.int32) + np.arange(codes.shape[1], dtype=np.int32) * 256).T
        out = tables.take(at[0], axis=1)
        for column in at[1:]:
            out += tables.take(column, axis=1)
        return out


def _one_way(home: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (home != cell) & ((cell > home) == ((cell + home) % 2 == 0))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; empty cells restart at a random vector."""
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        home = _nearest(x, centres, 1)[:, 0]
        order = np.argsort(home, kind="stable")
        counts = np.bincount(home, minlength=k)
        sums = np.zeros_like(centres)
        filled = np.flatnonzero(counts)
        sums[filled] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(counts[filled])[:-1]]), axis=0)
        norm = np.linalg.norm(sums, axis=1)
        lost = norm < 1e-9
        sums[lost] = x[rng.integers(0, len(x), lost.sum())]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres.astype(np.float32)


def _top(score: np.ndarray, m: int) -> np.ndarray:
    """The columns of the m greatest scores of each row, the greatest first."""
    m = min(m, score.shape[1])
    if m == 1:
        return score.argmax(1)[:, None]
    top = np.argpartition(-score, m - 1, axis=1)[:, :m] if m < score.shape[1] else np.tile(np.arange(m), (len(score), 1))
    order = np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1)


def _nearest(x: np.ndarray, centres: np.ndarray, m: int) -> np.ndarray:
    """The m best centres of each vector, the best first."""
    out = np.empty((len(x), min(m, len(centres))), np.int64)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = _top(x[a : a + 4096] @ centres.T, m)
    return out


def _residual_means(r: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Plain k-means of residuals; one centre at the origin is no second level."""
    if k == 1:
        return np.zeros((1, r.shape[1]), np.float32)
    centres = r[rng.choice(len(r), k, replace=len(r) < k)].copy()
    for _ in range(rounds):
        home = (r @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, r)
        counts = np.bincount(home, minlength=k)[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres.astype(np.float32)


def _assign(x: np.ndarray, codebooks: np.ndarray, eta: float, rounds: int = 2) -> np.ndarray:
    """Codes under the loss |r|^2 + (eta - 1) (r.x)^2, one part after another."""
    n, (m, words, d) = len(x), codebooks.shape
    parts = x.reshape(n, m, d)
    code = np.empty((n, m), np.uint8)
    along = np.zeros(n, np.float32)  # r.x so far
    for j in range(m):
        gap = ((parts[:, j, None, :] - codebooks[j]) ** 2).sum(2)
        code[:, j] = gap.argmin(1)
        along += ((parts[:, j] - codebooks[j][code[:, j]]) * parts[:, j]).sum(1)
    for _ in range(rounds):
        for j in range(m):
            r = parts[:, j, None, :] - codebooks[j]
            own = (r * parts[:, j, None, :]).sum(2)
            rest = along - own[np.arange(n), code[:, j]]
            loss = (r**2).sum(2) + (eta - 1) * (rest[:, None] + own) ** 2
            code[:, j] = loss.argmin(1)
            along = rest + own[np.arange(n), code[:, j]]
    return code


def _codebooks(x: np.ndarray, eta: float, rng: np.random.Generator, rounds: int = 4) -> np.ndarray:
    """Alternates codes and the least-squares codebooks of the score-aware loss."""
    n, dim = x.shape
    m, d = dim // 2, 2
    parts = x.reshape(n, m, d)
    books = np.stack([parts[rng.choice(n, WORDS, replace=n < WORDS), j] for j in range(m)]).astype(np.float32)
    for turn in range(rounds + 3):
        if turn < 3:  # plain k-means first
            code = np.stack([((parts[:, j, None] - books[j]) ** 2).sum(2).argmin(1) for j in range(m)], axis=1)
        else:
            code = _assign(x, books, eta, 1)
        column = np.arange(m) * WORDS + code
        weight = 0.0 if turn < 3 else eta - 1
        # x ~ sum of words: (D + weight U'U) c = (1 + weight) sum(U), U holding x at the words it uses
        size = m * WORDS * d
        u = np.zeros((n, size), np.float32)
        for k in range(d):
            u[np.arange(n)[:, None], column * d + k] = parts[:, :, k]
        counts = np.repeat(np.bincount(column.ravel(), minlength=m * WORDS), d).astype(np.float64)
        left = np.diag(counts + 1e-3)
        if weight:
            left += weight * (u.T @ u).astype(np.float64)
        right = (1 + weight) * u.sum(0, dtype=np.float64)
        right += 1e-3 * books.reshape(-1)
        books = np.linalg.solve(left, right).reshape(m, WORDS, d).astype(np.float32)
    return books


def fit(sample: np.ndarray, total: int, seed: int = 11, k: int = 10, recall: float = 0.99, coarse: int | None = None, fine: int | None = None) -> Index:
    """Fits cells and codebooks on unit vectors; ``total`` is the number to be indexed.

    At most HELD_OUT vectors are kept apart; the number of cells to visit is the
    least with which they find ``recall`` of their k nearest in the rest. True
    neighbours among all vectors are nearer than those in a sample, so the number
    errs on the safe side.
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    if dim % 4:
        raise ValueError("the width must be a multiple of 4")
    sample = np.unique(sample, axis=0)  # copies would make neighbours look easy to find
    sample = sample[rng.permutation(len(sample))]
    n = len(sample)
    if not n:
        return Index(np.eye(1, dim, dtype=np.float32), np.zeros((1, dim), np.float32), np.zeros((dim // 2, WORDS, 2), np.float32), np.ones(1, np.int64), 1.0, 1)
    held = min(HELD_OUT, n // 4)
    asked, rest = sample[:held], sample[held:]
    c = coarse or int(min(COARSE, max(1, np.sqrt(total)), max(1, len(rest) // 8)))
    f = fine or int(min(FINE, max(1, np.ceil(2 * total / (c * BLOCK)))) if c == COARSE else 1)
    centres = _kmeans(rest, c, rng)
    left = rest[:BLOCK]
    residual = _residual_means(left - centres[_nearest(left, centres, 1)[:, 0]], f, rng)
    eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    index = Index(centres, residual, _codebooks(rest[:8_192], eta, rng), np.ones(c * f, np.int64), eta, 1)
    homes = index.homes(rest)
    index.blocks = np.maximum(1, np.ceil(np.bincount(homes, minlength=c * f) / len(rest) * total / BLOCK)).astype(np.int64)
    if held:
        index.probes = _probes(index, asked, rest, homes, k, recall)
    return index


def _probes(index: Index, asked: np.ndarray, rest: np.ndarray, homes: np.ndarray, k: int, recall: float) -> int:
    ranks = []
    step = max(1, (1 << 24) // max(len(rest), len(index.blocks)))
    for a in range(0, len(asked), step):
        q = asked[a : a + step]
        near = _top(q @ rest.T, k)
        place = np.empty((len(q), len(index.blocks)), np.int64)
        np.put_along_axis(place, index.best(q, len(index.blocks)), np.arange(len(index.blocks))[None], 1)
        ranks.append(np.take_along_axis(place, homes[near], 1).ravel())
    return int(np.quantile(np.concatenate(ranks), recall, method="higher")) + 1


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Binary column to floats."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, np.float32)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def usable(df: DataFrame, key: str, group: str, vector: str, dim: int) -> DataFrame:
    """``key, grp, vec``: vectors of ``dim`` finite components that aren't all zero, as bytes.

    Rows with a null key take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            x = x + np.float32(0)  # a negative zero is a zero
            ok = np.isfinite(x).all(1) & (np.abs(x).sum(1, dtype=np.float64) > 0)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), _binary(x[ok])], names=["key", "grp", "vec"])

    right = (F.size(vector) == dim) & F.forall(vector, lambda v: v.isNotNull())
    narrow = df.filter(F.col(key).isNotNull() & right).select(F.col(key).cast("long").alias("key"), F.col(group).cast("long").alias("grp"), F.col(vector).cast("array<float>").alias("vec"))
    return narrow.mapInArrow(run, "key long, grp long, vec binary")


def _unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def fit_on(vectors: DataFrame, dim: int, k: int = 10, recall: float = 0.99) -> Index:
    """Fits an index on about SAMPLE of the vectors; all are counted."""
    total = vectors.count()
    sample = vectors.select("vec")
    if total > SAMPLE:
        # the hash of the bytes decides, so the sample doesn't depend on partitioning; copies are one vector of it
        sample = sample.filter(F.pmod(F.xxhash64("vec"), F.lit(1 << 40)) < int((1 << 40) * SAMPLE / total)).distinct().limit(2 * SAMPLE)
    rows = sample.toPandas()["vec"].tolist()
    x = _unit(np.frombuffer(b"".join(rows), np.float32).reshape(-1, dim)) if rows else np.empty((0, dim))
    return fit(x.astype(np.float32), total, k=k, recall=recall)


_HOME, _VISIT, _OWN = 0, 1, 2
_PLACED = "cell int, block int, kind int, key long, grp long, vec binary"
_ROWS = 16_384  # of a batch that is sent


def _spread(key: np.ndarray, vec: np.ndarray) -> np.ndarray:
    """A number from key and vector, so neither a hot key nor a hot vector fills one block."""
    with np.errstate(over="ignore"):
        words = np.ascontiguousarray(vec).view(np.uint32).astype(np.uint64)
        mixed = (words * (np.arange(words.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))).sum(1, dtype=np.uint64)
        mixed ^= key.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64)


def _place(vectors: DataFrame, index: Index, dim: int, homes: bool, probes: int = 0, reach: float | None = None) -> DataFrame:
    """Sends each vector to its home, and to every block of the cells it visits.

    ``probes``: the best cells. ``reach``: its own cell and others that may hold
    a vector so near; a pair meets in the home of one of the two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                raw = _vectors(b.column(2), dim)
                x = _unit(raw).astype(np.float32)
                n = np.arange(len(x))
                home = index.homes(x)
                parts = []
                if homes:
                    parts.append((n, home, _spread(b.column(0).to_numpy(), raw) % index.blocks[home], np.full(len(x), _HOME)))
                if probes:
                    step = max(1, (1 << 22) // len(index.blocks))
                    cells = np.concatenate([index.best(x[i : i + step], probes) for i in range(0, len(x), step)])
                    row, cell, kind = np.repeat(n, cells.shape[1]), cells.ravel(), np.full(cells.size, _VISIT)
                elif reach is not None:
                    row, cell = index.within(x, home, reach)
                    row, cell, kind = np.concatenate([n, row]), np.concatenate([home, cell]), np.concatenate([np.full(len(x), _OWN), np.full(len(row), _VISIT)])
                if probes or reach is not None:
                    times = index.blocks[cell]
                    block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    parts.append((np.repeat(row, times), np.repeat(cell, times), block, np.repeat(kind, times)))
                row, cell, block, kind = (np.concatenate(c) for c in zip(*parts))
                for i in range(0, len(row), _ROWS):
                    take = pa.array(row[i : i + _ROWS])
                    out = [pa.array(c[i : i + _ROWS].astype(np.int32)) for c in (cell, block, kind)]
                    yield pa.RecordBatch.from_arrays([*out, *(b.column(j).take(take) for j in range(3))], names=["cell", "block", "kind", "key", "grp", "vec"])

    return vectors.mapInArrow(run, _PLACED)


def _once(k: np.ndarray, g: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without rows that are repeated as they are."""
    whole = np.concatenate([k[:, None].view(np.uint8), g[:, None].view(np.uint8), np.ascontiguousarray(v).view(np.uint8)], axis=1)
    _, first = np.unique(whole.view(np.dtype((np.void, whole.shape[1]))).ravel(), return_index=True)
    return k[first], g[first], v[first]


def _compare(placed: DataFrame, index: Index, dim: int, prepare, pick, schema: str) -> DataFrame:
    """Streams each block: first its homes, made ready by ``prepare``, then its visitors in batches through ``pick``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        waiting: list[tuple] = []
        held = 0
        homes = None
        for b in batches:
            cell, block, kind, key = (b.column(i).to_numpy() for i in range(4))
            grp = b.column(4).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)
            x = _vectors(b.column(5), dim)
            cut = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            edges = [0, *cut, len(cell)]
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                if (here := (int(cell[a]), int(block[a]))) != at:
                    at, waiting, held, homes = here, [], 0, None
                if kind[a] == _HOME:
                    waiting.append((key[a:z], grp[a:z], x[a:z]))
                    held += z - a
                    if held > 2 * BLOCK:  # rows delivered again don't pile up
                        waiting = [_once(*(np.concatenate(c) for c in zip(*waiting)))]
                        held = 0
                    continue
                if homes is None and waiting:
                    k, g, v = _once(*(np.concatenate(c) for c in zip(*waiting)))
                    v = _unit(v)
                    codes = index.encode(v.astype(np.float32))
                    homes, waiting = (k, g, v, codes, prepare(v, codes)), []
                if homes is None:
                    continue
                step = max(1, (1 << 21) // len(homes[0]))
                for s in range(a, z, step):
                    e = min(z, s + step)
                    out = pick(key[s:e], grp[s:e], _unit(x[s:e]), bool(kind[a] == _OWN), *homes)
                    if len(out[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=[f.split()[0] for f in schema.split(", ")])

    return placed.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind").mapInArrow(run, schema)


def neighbours(queries: DataFrame, base: DataFrame, dim: int, k: int = 10, recall: float = 0.99, index: Index | None = None, exact: bool = False) -> DataFrame:
    """``key, rank, neighbour, cosine``: the k most similar vectors with another ``grp``.

    Both inputs come from ``usable``. Equal cosines are ranked by key; repeated
    rows count once; two null groups are the same group. Queries without any
    candidate give no rows. A query visits the cells that held-out queries need
    for ``recall``; in each block the ``5 k`` best by the tables are compared
    exactly. ``exact`` visits all cells and compares everything.
    """
    index = index or fit_on(base, dim, k, recall)
    few = k if exact else 5 * k

    def pick(qk, qg, q, own, hk, hg, h, codes, _):
        scores = q @ h.T if exact else index.scan(index.tables(q.astype(np.float32)), codes)
        scores = np.where(qg[:, None] == hg[None, :], -np.inf, scores)
        n = min(few, scores.shape[1])
        if n < scores.shape[1] and exact:  # everything as good as the k-th stays: ties are settled by key
            row, col = np.nonzero(scores >= -np.partition(-scores, n - 1, axis=1)[:, n - 1 : n] - 1e-12)
        else:
            col = _top(scores, n)
            row, col = np.repeat(np.arange(len(q)), n), col.ravel()
        ok = np.isfinite(scores[row, col])
        row, col = row[ok], col[ok]
        return qk[row], hk[col], np.einsum("ij,ij->i", q[row], h[col])

    placed = _place(base, index, dim, True).unionByName(_place(queries, index, dim, False, len(index.blocks) if exact else index.probes))
    found = _compare(placed, index, dim, lambda v, codes: None, pick, "key long, neighbour long, cosine double")
    once = found.groupBy("key", "neighbour").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("key").orderBy(F.col("cosine").desc(), "neighbour")
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("key", "rank", "neighbour", "cosine")


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cls, rep, key, grp`` of every vector, each once, and ``key, grp, vec`` of every class of equal vectors.

    Classes are numbered and have their smallest key as representative; a class'
    grp is null. Vectors are told apart by a 128-bit hash of their bytes.
    """
    checkpoint_dir(vectors.sparkSession)
    tagged = vectors.withColumn("h", F.unhex(F.md5("vec")))
    # numbers are drawn once and written: a key may hold several vectors, so it can't name a class
    single = tagged.groupBy("h").agg(F.min("key").alias("rep"), F.first("vec").alias("vec")).withColumn("cls", F.monotonically_increasing_id()).checkpoint()
    members = tagged.select("h", "key", "grp").distinct().join(single.select("h", "cls", "rep"), "h").select("cls", "rep", "key", "grp")
    return members, single.select(F.col("cls").alias("key"), F.lit(None).cast("long").alias("grp"), "vec")


def class_links(single: DataFrame, dim: int, least: float, index: Index, sigmas: float | None = SIGMAS) -> DataFrame:
    """``x, y, cosine``: pairs of classes (x < y) with a cosine of at least ``least``, each once.

    Two such vectors are at most sqrt(2 - 2 least) apart. Across one border the
    difference is that length times a cosine whose deviation is 1/sqrt(dim) if
    directions are random; borders further than ``sigmas`` of it aren't crossed.
    Without ``sigmas`` the whole length counts and no pair can be lost.
    """
    reach = float(np.sqrt(max(2 - 2 * least, 0))) * (1.0 if sigmas is None else min(1.0, sigmas / np.sqrt(dim)))

    def pick(qk, qg, q, own, hk, hg, h, codes, lift):
        scores = index.scan(index.tables(q.astype(np.float32)), codes)
        row, col = np.nonzero(scores >= (least - lift)[None, :])
        keep = qk[row] < hk[col] if own else qk[row] != hk[col]
        row, col = row[keep], col[keep]
        exact = np.einsum("ij,ij->i", q[row], h[col]) if len(row) else np.empty(0)
        keep = exact >= least
        a, b = qk[row][keep], hk[col][keep]
        return np.minimum(a, b), np.maximum(a, b), exact[keep]

    placed = _place(single, index, dim, True, reach=reach)
    return _compare(placed, index, dim, lambda v, codes: index.lift(v, codes, least), pick, "x long, y long, cosine double")


def linked_classes(vectors: DataFrame, dim: int, least: float, index: Index | None = None, sigmas: float | None = SIGMAS) -> tuple[DataFrame, DataFrame]:
    """``cls, rep, key, grp``: the class of each vector; ``x, y, cosine``: pairs of classes at least ``least`` similar.

    This is the result that grows with the vectors, not with the pairs of their
    copies. Written once, as both are used several times.
    """
    checkpoint_dir(vectors.sparkSession)
    vectors = vectors.checkpoint()
    index = index or fit_on(vectors, dim)
    members, single = classes(vectors)
    return members.checkpoint(), class_links(single, dim, least, index, sigmas).checkpoint()


def similar_pairs(vectors: DataFrame, dim: int, least: float, index: Index | None = None, sigmas: float | None = SIGMAS) -> DataFrame:
    """``a, b, cosine``: pairs of keys (a < b) with different ``grp`` and a cosine of at least ``least``.

    Exact copies are searched as one class and expanded only here at the end, so
    a vector that a third of all rows share is compared once. Repeated rows and
    several rows of one key give each pair once. A null group differs from all
    others but not from another null. ``sigmas`` is that of ``class_links``: None
    finds every pair for certain.
    """
    members, between = linked_classes(vectors, dim, least, index, sigmas)
    several = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    within = several.select(F.col("cls").alias("x"), F.col("cls").alias("y"), F.lit(1.0).alias("cosine"))
    links = between.unionByName(within) if least <= 1 else between
    left = members.select(F.col("cls").alias("x"), F.col("key").alias("ka"), F.col("grp").alias("ga"))
    right = members.select(F.col("cls").alias("y"), F.col("key").alias("kb"), F.col("grp").alias("gb"))
    full = links.join(left, "x").join(right, "y").filter(~F.col("ga").eqNullSafe(F.col("gb")) & (F.col("ka") != F.col("kb")) & ((F.col("x") != F.col("y")) | (F.col("ka") < F.col("kb"))))
    return full.groupBy(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).agg(F.max("cosine").alias("cosine"))
