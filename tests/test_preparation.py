"""Heavy keys, incremental processing and orphan references against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest

from corvine.operators import heavy_keys, incremental, orphans

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
EDGE = "id long, caller_id long, callee_id long, created_at timestamp, n_items string, key string"


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_per_key_summary(spark, partitions):
    rng = random.Random(partitions)
    rows = []
    for i in range(3000):
        callee = None if rng.random() < 0.02 else 1 if rng.random() < 0.4 else rng.randrange(50)
        caller = None if rng.random() < 0.05 else rng.randrange(3 if callee == 1 else 20)
        rows.append((i, caller, callee, None if rng.random() < 0.1 else T0 + timedelta(seconds=rng.randrange(9999)), "a", "b"))
    want = defaultdict(lambda: [set(), set(), None])
    for i, caller, callee, t, *_ in rows:
        w = want[callee]
        w[0].add(i)
        if caller is not None:
            w[1].add(caller)
        w[2] = t if w[2] is None else max(w[2], t or w[2])
    df = spark.createDataFrame(rows + rows[:500], EDGE)
    got = heavy_keys.per_key_summary(df, "callee_id", "caller_id", "id", "created_at", partitions)
    assert {r.key: (r.n_items, r.n_members, r.last_ts) for r in got.collect()} == {k: (len(a), len(b), t and t.replace(tzinfo=None)) for k, (a, b, t) in want.items()}
    assert {r.key for r in heavy_keys.heavy_keys(got, 0.3).collect()} == {1}


def test_per_key_summary_of_nothing(spark):
    df = spark.createDataFrame([], EDGE)
    s = heavy_keys.per_key_summary(df, "callee_id", "caller_id", "id", "created_at", 4)
    assert s.count() == 0 and heavy_keys.heavy_keys(s, 0.1).count() == 0


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_orphans(spark, ranges):
    rng = random.Random(ranges)
    day = lambda n: None if n is None else T0 + timedelta(days=n)
    parents = []
    for i in range(120):
        for _ in range(rng.choice([1, 1, 2, 3])):
            a = rng.randrange(50)
            parents.append((rng.randrange(90), None if rng.random() < 0.05 else a, None if rng.random() < 0.3 else a + rng.randrange(20), "x"))
    refs = [(i, None if rng.random() < 0.1 else 7 if rng.random() < 0.4 else rng.randrange(120), rng.randrange(120), None if rng.random() < 0.05 else rng.randrange(80), "y") for i in range(1500)]
    want = set()
    for i, a, b, t, _ in refs:
        for field, k in (("caller_id", a), ("callee_id", b)):
            if k is None:
                continue
            mine = [(s, e) for p, s, e, _ in parents if p == k]
            begun = [(s, e) for s, e in mine if t is not None and s is not None and s <= t]
            if not any(e is None or t < e for _, e in begun):
                want.add((i, field, "missing" if not mine else "deleted" if begun else "late"))
    left = spark.createDataFrame([(i, a, b, day(t), y) for i, a, b, t, y in refs + refs[:200]], "id long, caller_id long, callee_id long, created_at timestamp, key string")
    right = spark.createDataFrame([(p, day(s), day(e), x) for p, s, e, x in parents + parents[:20]], "id long, indexed_at timestamp, deleted_at timestamp, key string")
    got = orphans.orphans(left, "id", ["caller_id", "callee_id"], "created_at", right, "id", "indexed_at", "deleted_at", ranges, 1.0)
    rows = [(r.ref_id, r.ref_field, r.orphan_kind) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    none = orphans.orphans(left, "id", ["caller_id"], "created_at", right.limit(0), "id", "indexed_at", "deleted_at", ranges)
    assert {r.orphan_kind for r in none.collect()} == {"missing"}
    assert orphans.orphans(left.limit(0), "id", ["caller_id"], "created_at", right, "id", "indexed_at", "deleted_at", ranges).count() == 0


def test_pending(spark):
    cur = spark.createDataFrame([(1, "A"), (2, "b"), (3, "c"), (4, None), (5, None)], "content_id long, content_hash string")
    done = spark.createDataFrame([(1, "A"), (2, "x"), (4, None), (9, "z")], "content_id long, content_hash string")
    got = incremental.pending(cur, done, "content_id", "content_hash", 3).collect()
    assert {r.content_id for r in got} == {2, 3, 5}
    assert incremental.pending(cur.limit(0), done, "content_id", "content_hash").count() == 0
    assert incremental.pending(cur, done.limit(0), "content_id", "content_hash").count() == 5


def test_runs_that_fail_lose_nothing_and_repeat_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    calls = []

    def derive(df):
        calls.append(sorted(r.content_id for r in df.select("content_id").collect()))
        return df.withColumn("done", F.upper("content_hash")).drop("content_hash")

    job = incremental.IncrementalJob(spark, str(tmp_path / "state"), "content_id", "content_hash", derive, buckets=8)
    table = lambda rows: spark.createDataFrame(rows, "content_id long, content_hash string")
    first = [(i, f"h{i}") for i in range(60)]
    assert job.rows() is None and job.run(table([])) == 0
    assert job.stage(table(first)).n_changed == 8 and job.version() == 0  # dies before the commit
    assert job.run(table(first)) == 8 and job.rows().count() == 60
    assert job.run(table(first)) == 0
    second = [(i, f"h{i}") for i in range(1, 60)] + [(100, "new")]
    second[4] = (5, "changed")
    n = job.run(table(second))
    assert 0 < n <= 3 and len(calls[-1]) < 40
    assert sorted((r.content_id, r.done) for r in job.rows().collect()) == sorted((i, h.upper()) for i, h in second)
    assert job.run(table(second)) == 0
    # partitions that vanish, or that derive nothing any more, leave no rows behind
    assert job.run(table(second[:1])) == 8 and [r.content_id for r in job.rows().collect()] == [1]
    job.derive = lambda df: derive(df).limit(0)
    assert job.run(table([(1, "other")])) == 1 and job.rows().count() == 0


def test_partitions_by_period_are_skipped(spark, tmp_path):
    from pyspark.sql import functions as F

    job = incremental.IncrementalJob(spark, str(tmp_path / "state"), "id", "v", lambda df: df, F.date_format("t", "yyyy-MM-dd"))
    feed = lambda rows: spark.createDataFrame([(i, v, T0 + timedelta(days=d) if d is not None else None) for i, v, d in rows], "id long, v string, t timestamp")
    first = [(1, "a", 0), (1, "a", 0), (1, "b", 1), (2, None, 1), (3, "c", None), (None, "x", 0)]
    assert job.run(feed(first)) == 3 and job.rows().count() == 5
    staged = job.stage(feed([*first, (4, "d", 2), (5, "e", 1)]))
    assert (staged.n_parts, staged.n_changed) == (4, 2)
    job.commit(staged)
    assert sorted(r.id for r in job.rows().collect()) == [1, 1, 1, 2, 3, 4, 5] and job.version() == 2


def test_pending_content_goes_through_the_job(spark):
    content = spark.createDataFrame([(i, f"H{i % 7}", T0 + timedelta(days=d)) for i in range(200) for d in (0, i % 2)], "id long, content_hash string, updated_at timestamp")
    ledger = spark.createDataFrame([(i, f"h{i % 5}", o, r, T0) for i in range(150, 300) for o, r in (("ok", 1), ("error", 1), ("ok", 2))], "content_id long, content_hash string, outcome string, run_id long, processed_at timestamp")
    runs = spark.createDataFrame([(1, "completed"), (2, "failed")], "run_id long, status string")
    got = sorted(tuple(r) for r in incremental.pending_content(content, ledger, runs).select("content_id", "content_hash").collect())
    assert got == [(i, f"h{i % 7}") for i in range(200) if i < 150 or i % 7 != i % 5]
    assert incremental.pending_content(content.limit(0), ledger, runs).count() == 0
    assert incremental.pending_content(content, ledger.limit(0), runs).count() == 200


def test_the_job_is_registered_over_whole_tables(spark, monkeypatch):
    import hashlib

    from corvine.plans import preparation

    tables = {
        "indexed_content": spark.createDataFrame([(i, f"H{i % 7}", T0 + timedelta(days=d)) for i in range(200) for d in (0, i % 2)], "id long, content_hash string, updated_at timestamp"),
        "content_ledger": spark.createDataFrame([(i, f"h{i % 5}", "ok", 1, T0) for i in range(150, 300)], "content_id long, content_hash string, outcome string, run_id long, processed_at timestamp"),
        "index_run": spark.createDataFrame([(1, "completed", T0 + timedelta(hours=5))], "run_id long, status string, started_at timestamp"),
    }
    monkeypatch.setattr(preparation, "table", lambda spark, base, name: tables[name])
    got = sorted(tuple(r) for r in preparation.QUERIES["p4_replaced"](spark, "").select("content_id", "content_hash", "digest").collect())
    assert got == sorted((i, h, hashlib.md5(h.encode()).hexdigest()) for i in range(200) for h in [f"h{i % 7}"] for _ in range(1 + i % 2))
    assert tuple(preparation.QUERIES["p4_skipped"](spark, "").first()) == (2, 1, 1)
