"""Chunks, work lists, caches of answers and query texts on literal tables."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corvine.functions import columns as c
from corvine.functions import text as tx
from corvine.operators import chunks, extraction, impact, work

NOW = "2025-06-20 12:00:00"
T = lambda h: datetime(2025, 6, 20, h)


def test_numbers_have_no_gaps(spark):
    df = spark.createDataFrame([(i * 7 % 1000, "x") for i in range(1000)], "node long, clash string").repartition(7)
    got = chunks.numbered(df, ["node"]).collect()
    assert sorted((r.node, r["index"]) for r in got) == [(i, i) for i in range(1000)]
    assert chunks.numbered(df.limit(0), ["node"]).count() == 0
    parts = chunks.by_size(df.unionByName(df.limit(5)), 300).groupBy("part").count().collect()
    assert sorted((r.part, r["count"]) for r in parts) == [(0, 300), (1, 300), (2, 300), (3, 100)]


def test_chunks_come_together_again(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (5, 1), (5, 1), (None, 2), (9, 1)], "src long, dst long")
    parts = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, 2)], "node long, part long")
    names = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "node long, name string")
    built, boundary = chunks.build(parts, edges, names)
    nodes, back = chunks.reassemble(built, boundary)
    assert {(r.src, r.dst) for r in back.collect()} == {(1, 2), (2, 3), (3, 1), (4, 5), (5, 1)}
    assert {r.node: r.attributes for r in nodes.collect()} == {1: '{"name":"a"}', 2: "{}", 3: '{"name":"c"}', 4: "{}", 5: "{}"}
    assert [r.part for r in chunks.stream(built)] == [0, 1, 2] and boundary.count() == 4
    assert tuple(chunks.estimate(parts, edges, 2, 3).first()) == (5, 8, 3) and chunks.estimate(parts.limit(0), edges.limit(0)).first().n_chunks == 1


def test_compressed_texts_are_restored(spark):
    texts = ["", "ä" * 1000, "x\n" * 50_000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    packed = chunks.compressed(df, "id", "text")
    back = {r.id: r.text for r in chunks.restored(packed, "id", "payload").collect()}
    assert back == dict(enumerate(texts))
    row = {r.id: r for r in packed.collect()}
    assert row[1].size_bytes == 2000 and row[1].ratio < 0.1 and row[0].ratio is None and row[3].payload is None


def test_manifests(spark):
    kind = "chunk_id string, path string, version string, size_bytes long, total_bytes long, created string"
    good = spark.createDataFrame([("a", "p1", "1.0.0", 3, 7, "2025-06-20T12:00:00Z"), ("b", "p2", "1.2.0", 4, 7, "2025-06-20T12:00:00.5+02:00")], kind)
    assert chunks.manifest_problems(good).count() == 0 and chunks.manifest_problems(good.limit(0)).count() == 0
    bad = spark.createDataFrame([("a", "p", "1.0", 3, 9, "20.6.2025"), ("a", "p", None, 4, 9, None)], kind)
    assert {(r.problem, r.n) for r in chunks.manifest_problems(bad).collect()} == {("repeated id", 1), ("repeated path", 1), ("version", 2), ("time", 2), ("total", 1)}
    new = spark.createDataFrame([("b", "p3", "1.2.1", 10, 0, "2025-06-21T12:00:00Z"), ("c", "p4", "1.2.1", 1, 0, "2025-06-21T12:00:00Z")], kind)
    got = chunks.updated_manifest(good, new, good.filter("chunk_id = 'a'")).collect()
    assert sorted((r.chunk_id, r.size_bytes, r.total_bytes) for r in got) == [("b", 10, 11), ("c", 1, 11)]


def test_items_go_through_their_states(spark):
    none = spark.createDataFrame([], "chunk_id string, status string, attempts int, changed_at timestamp")
    listed = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "chunk_id string")
    items = work.enlist(none, listed)
    taken = work.claim(items, 2, NOW)
    assert {r.chunk_id: (r.status, r.attempts) for r in taken.collect()} == {"a": ("PROCESSING", 1), "b": ("PROCESSING", 1), "c": ("PENDING", 0)}
    assert work.claim(items, 2, NOW, after="b").filter("status = 'PROCESSING'").first().chunk_id == "c"
    done = work.settle(taken, spark.createDataFrame([("a", True), ("a", False), ("b", False), ("c", True)], "chunk_id string, ok boolean"), NOW, 3)
    assert {r.chunk_id: r.status for r in done.collect()} == {"a": "COMPLETED", "b": "PENDING", "c": "PENDING"}
    again = work.claim(done, 5, NOW)
    assert {r.chunk_id: r.status for r in work.release(again, "2025-06-20 14:00:00", 60, 2).collect()} == {"a": "COMPLETED", "b": "FAILED", "c": "PENDING"}
    assert {r.status for r in work.release(again, "2025-06-20 12:30:00", 60, 2).collect()} == {"COMPLETED", "PROCESSING"}
    assert work.enlist(done, listed).count() == 3 and work.enlist(done, listed, force=True).filter("status = 'PENDING'").count() == 3


def test_reindex(spark):
    docs = spark.createDataFrame([(1, "COMPLETED", 4, T(1), T(2)), (2, "processing", 3, T(1), T(2)), (3, None, 1, None, None), (4, "FAILED", 0, None, T(1))], "id long, status string, chunk_count int, indexed_at timestamp, updated_at timestamp")
    vecs = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, 4), (14, None)], "id long, content_id long")
    after, left = work.reindex(docs, vecs, F.col("id") < 4, NOW)
    assert {r.id: (r.status, r.chunk_count) for r in after.collect()} == {1: ("PENDING", 0), 2: ("processing", 3), 3: ("PENDING", 0), 4: ("FAILED", 0)}
    assert {r.id for r in left.collect()} == {11, 13, 14}


def test_cache_of_answers(spark):
    kind = "key string, version string, answer string, created_at timestamp, expires_at timestamp, hits long"
    cache = spark.createDataFrame([("k", "1", "old", T(1), T(23), 2), ("k", "2", "other", T(3), T(23), 0), ("x", None, "gone", T(1), T(2), 0)], kind)
    new = spark.createDataFrame([("k", "1", "new", T(4), T(23), 0)], kind)
    merged = work.with_answers(cache, new)
    assert {(r.key, r.version): (r.answer, r.hits) for r in merged.collect()} == {("k", "1"): ("new", 3), ("k", "2"): ("other", 0), ("x", None): ("gone", 0)}
    asked = spark.createDataFrame([(1, "k", "2"), (2, "k", None), (3, "x", None), (4, "nothing", None)], "query_id int, key string, version string")
    assert {r.query_id: r.answer for r in work.cached(merged, asked, NOW).collect()} == {1: "other", 2: "new"}
    assert spark.range(1).select(work.query_key(F.lit(" A  b\n")) == work.query_key(F.lit("a b"))).first()[0]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("How does  MEM work!!!", "how does mem memory heap stack work!"),
        ("kmalloc_node() Fails in DMA", "kmalloc_node() fails in dma direct memory heap stack access"),
        ("CONFIG_SMP and HugePage", "CONFIG_SMP and HugePage"),
        ("lock, please....", "lock, mutex semaphore please..."),
        ("   ", ""),
        (None, ""),
    ],
)
def test_questions_are_enriched(spark, query, want):
    assert spark.createDataFrame([(query,)], "q string").select(tx.enriched("q")).first()[0] == want


def test_expansions_have_their_own_table(spark):
    got = spark.createDataFrame([("alloc skb",), ("my_pid",), ("lock",)], "q string").select(tx.expansions("q").alias("e")).collect()
    assert [r.e for r in got] == [["alloc skb", "allocate skb", "allocation skb", "alloc socket_buffer", "alloc sk_buff"], ["my_pid", "my pid"], ["lock"]]


def test_json(spark):
    df = spark.createDataFrame([('["a","b"]',), ('["a"]',), ("{broken",), (None,)], "j string")
    assert [r[0] for r in df.select(c.json_array_holds("j", "a", "b")).collect()] == [True, False, False, False]
    assert spark.range(1).select(c.as_json(F.lit(1).alias("x"), F.struct(F.lit("y").alias("z")).alias("s"))).first()[0] == '{"x":1,"s":{"z":"y"}}'
    ids = spark.range(3).select(chunks.stable_uuid("id").alias("u"))
    assert {r.u for r in ids.collect()} == {r.u for r in ids.repartition(2).collect()} and ids.distinct().count() == 3


def test_patterns_and_their_lines():
    text = "\x01\nEXPORT_SYMBOL(a); EXPORT_SYMBOL_GPL(b);\n#define X_MAGIC 0x10\n#define GET _IOR(X_MAGIC, 3, int)\n#define RUN _IO('q', 7)\nrequest_irq(1, on_irq, IRQF_ONESHOT, 0);\ndevm_request_irq(d, 1, on_dev, 0, 0);\nsysfs_create_file(k, &mode.attr);\nstatic struct netlink_kernel_cfg cfg = {\n .groups = 1,\n .input = receive };\n"
    got = extraction.find_patterns(text)
    assert [(k, n, d, line) for k, n, d, line in got if k == "export"] == [("export", "a", None, 2), ("export", "b", "_GPL", 2)]
    assert {(k, n, line) for k, n, _, line in got if k != "export"} >= {("interrupt", "on_irq", 6), ("interrupt", "on_dev", 7), ("interrupt_flag", "IRQF_ONESHOT", 6), ("sysfs", "mode", 8), ("netlink_input", "receive", 9)}
    assert extraction.find_ioctls(text) == [("GET", "read", "0x10", "3", "int", 4), ("RUN", "none", "q", "7", None, 5)]


def test_headers_and_the_critical_path(spark):
    changed = spark.createDataFrame([("s", "include/net/a.h"), ("m", "b.h"), ("f", "x.c")], "symbol string, path string")
    inc = spark.createDataFrame([("1.c", "net/a.h"), ("2.c", "other/a.h"), ("3.c", "b.h"), ("4.c", "x.c")], "file string, header string")
    assert {(r.symbol, r.includer) for r in impact.header_impact(changed, inc).collect()} == {("s", "1.c"), ("m", "3.c")}
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4)], "src long, dst long")
    assert [r.node for r in impact.critical_path(edges, 3, 1).orderBy("pos").collect()] == [1, 2, 3]
