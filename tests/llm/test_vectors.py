"""Similar vectors against brute force: recall, copies, unusable rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvine.llm import vectors as v

DIM = 16


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, content_id long, embedding array<float>, key string")


def make(n, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, DIM))
    x = centre[rng.integers(0, 12, n)] + rng.normal(size=(n, DIM)) * 0.6
    twins = rng.choice(n, n // 4, replace=False)
    x[twins[: len(twins) // 2]] = x[twins[len(twins) // 2 : 2 * (len(twins) // 2)]] * 2 + rng.normal(size=(len(twins) // 2, DIM)) * 0.05
    return x.astype(np.float32)


def test_pairs_and_neighbours_against_brute_force(spark):
    x = make(1500)
    rows = [(i, i // 2, [float(f) for f in e], "clash") for i, e in enumerate(x)]
    rows += [(5000, 1, None, None), (5001, 1, [0.0] * DIM, None), (5002, 1, [1.0] * 8, None), (5003, 1, [float("nan")] * DIM, None), (None, 1, [1.0] * DIM, None)]
    rows += rows[:40]  # delivered again
    usable = v.usable(frame(spark, rows), "id", "content_id", "embedding", DIM)
    u = v._unit(x)
    s = u @ u.T
    want = {(a, b) for a, b in zip(*np.nonzero(s >= 0.95)) if a < b and a // 2 != b // 2}
    got = v.similar_pairs(usable, DIM, 0.95).collect()
    found = {(r.a, r.b) for r in got}
    assert len(got) == len(found) and found == want and len(want) > 0

    near = v.neighbours(usable.filter(F.col("key") % 100 == 0), usable, DIM, 10).collect()
    hit = 0
    for q in range(0, 1500, 100):
        mine = [r.neighbour for r in sorted(near, key=lambda r: r["rank"]) if r.key == q]
        assert len(mine) == 10 == len(set(mine)) and all(m // 2 != q // 2 for m in mine)
        order = [int(i) for i in np.argsort(-s[q], kind="stable") if i // 2 != q // 2][:10]
        hit += len({*mine} & {*order})
    assert hit >= 0.9 * 150


@pytest.mark.parametrize(("coarse", "fine"), [(30, 1), (6, 7), (1, 40)])
def test_no_pair_is_lost_whatever_the_cells(spark, coarse, fine):
    x = make(900, 8)
    unit = v._unit(x)
    s = unit @ unit.T
    usable = v.usable(frame(spark, [(i, i, [float(f) for f in e], "") for i, e in enumerate(x)]), "id", "content_id", "embedding", DIM)
    index = v.fit(unit.astype(np.float32), 900, coarse=coarse, fine=fine)
    assert len(index.blocks) == len(index.centres) * len(index.fine)
    for least in (0.95, 0.8):
        want = {(a, b) for a, b in zip(*np.nonzero(s >= least)) if a < b}
        assert {(r.a, r.b) for r in v.similar_pairs(usable, DIM, least, index, None).collect()} == want
    near = v.neighbours(usable.filter(F.col("key") < 5), usable, DIM, 10, index=index, exact=True).collect()
    for q in range(5):
        order = [int(i) for i in np.argsort(-s[q], kind="stable") if i != q][:10]
        assert [r.neighbour for r in sorted(near, key=lambda r: r["rank"]) if r.key == q] == order


@pytest.mark.parametrize("spread", [0.25, 50.0])
def test_probes_reach_the_recall(spread):
    """Clustered and unstructured vectors: the cells found on held-out queries hold the neighbours of others."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(200, 32))
    x = v._unit(centre[rng.integers(0, 200, 12_000)] + rng.normal(size=(12_000, 32)) * spread).astype(np.float32)
    index = v.fit(x[:6_000], len(x))
    homes = index.homes(x)
    q = x[6_000:7_000]
    near = v._top(q @ x.T, 11)[:, 1:]
    seen = (index.best(q, index.probes)[:, None, :] == homes[near][:, :, None]).any(2)
    assert seen.mean() >= 0.9


def test_one_key_with_many_vectors_and_repeats(spark):
    x = make(400, 6)
    rows = [(7, i % 50, [float(f) for f in e], "") for i, e in enumerate(x[:300])] + [(1000 + i, 60 + i, [float(f) for f in e], "") for i, e in enumerate(x[300:])] * 5
    usable = v.usable(frame(spark, rows), "id", "content_id", "embedding", DIM)
    unit = v._unit(x)
    s = unit[300:] @ unit[300:].T
    got = {(r.a, r.b) for r in v.similar_pairs(usable, DIM, 0.95).collect()}
    want = {(1000 + a, 1000 + b) for a, b in zip(*np.nonzero(s >= 0.95)) if a < b}
    mixed = {(7, 1000 + int(b)) for a, b in zip(*np.nonzero(unit[:300] @ unit[300:].T >= 0.95))}
    assert got == want | mixed


def test_a_third_are_copies(spark):
    x = make(60)
    rows = [(i, i, [float(f) for f in x[i]], "") for i in range(60)] + [(100 + i, 7 if i < 3 else None, [float(f) for f in x[0]], "") for i in range(30)]
    got = {(r.a, r.b) for r in v.similar_pairs(v.usable(frame(spark, rows), "id", "content_id", "embedding", DIM), DIM, 0.95).collect()}
    assert (0, 100) in got and (100, 103) in got and (100, 101) not in got and (103, 104) not in got


def test_empty(spark):
    none = v.usable(frame(spark, []), "id", "content_id", "embedding", DIM)
    assert v.similar_pairs(none, DIM, 0.95).count() == 0 and v.neighbours(none, none, DIM).count() == 0


def test_score_aware_codes_lose_less_along_the_vector():
    rng = np.random.default_rng(5)
    x = v._unit(rng.normal(size=(3000, 64))).astype(np.float32)
    index = v.fit(x, 3000)
    plain = v._assign(x, index.codebooks, 1.0)
    aware = v._assign(x, index.codebooks, index.eta)
    along = lambda code: np.abs(((x - index.codebooks[np.arange(code.shape[1]), code].reshape(x.shape)) * x).sum(1)).mean()
    assert along(aware) < along(plain)
    codes = index.encode(x[:50])
    decoded = index.codebooks[np.arange(32), _unpack(codes)].reshape(50, 64)
    assert np.allclose(index.decode(codes), decoded)
    assert np.allclose(index.scan(index.tables(x[:7]), codes), x[:7] @ decoded.T, atol=1e-5)


def _unpack(codes):
    out = np.empty((len(codes), codes.shape[1] * 2), np.uint8)
    out[:, 0::2], out[:, 1::2] = codes & 15, codes >> 4
    return out
