"""Search, tables, statistics, impact, columns and streams on small cases."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvine.functions import columns as c
from corvine.functions import text as tx
from corvine.functions import vector as vec
from corvine.operators import impact, search, tables
from corvine.operators import statistics as st
from corvine.streaming import jobs


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("__x")).select(column.alias("v")).first().v


def test_tokens(spark):
    assert one(spark, tx.tokens("t"), t="MEMORY Allocation ERROR") == ["memory", "allocation", "error"]
    assert one(spark, tx.tokens("t"), t="memory_allocation buffer->data a naïve 字") == ["memory_allocation", "buffer", "data", "naïve"]
    assert one(spark, tx.jaccard(tx.token_set("a"), tx.token_set("b")), a="a b c", b="b c d") == 0.5
    assert one(spark, tx.jaccard(tx.token_set("a"), tx.token_set("b")), a="", b=" ") == 0.0


def test_rewriting(spark):
    assert one(spark, tx.rewrite("t"), t="  the FS   init of a dev ") == "filesystem initialize device"
    assert one(spark, tx.rewrite("t"), t="") == ""
    assert one(spark, tx.with_synonyms("t"), t="lock it") == "lock mutex semaphore it"
    # expansions have a table of their own, not that of the synonyms
    assert one(spark, tx.expansions("t"), t="fs alloc lock") == ["fs alloc lock", "filesystem alloc lock", "file_system alloc lock", "fs allocate lock", "fs allocation lock"]
    assert one(spark, tx.expansions("t"), t="vfs_read") == ["vfs_read", "vfs read"]
    assert one(spark, tx.keywords("t"), t="fs is on") == ["filesystem"]
    assert one(spark, tx.exact_boost(F.lit(1.0), "n", "q"), n="Read", q="read") == pytest.approx(3.375)


def test_citations(spark):
    sha = "0123456789" * 4
    text = one(spark, tx.citation("p", "a", "b", "s"), p="fs/a.c", a=3, b=7, s=sha)
    assert text == "fs/a.c:3-7@01234567"
    back = one(spark, tx.parse_citation("t"), t=text)
    assert (back.path, back.start, back.end, back.sha) == ("fs/a.c", 3, 7, "01234567" + "0" * 32)
    assert one(spark, tx.parse_citation("t"), t="nothing") is None
    assert one(spark, tx.context_lines("t", "q", 2), t="no\nring lock\nlock\nring lock x", q="lock ring") == ["ring lock", "ring lock x"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = df.select(vec.cosine("a", "b").alias("c"), vec.cosine("a", "z").alias("z"), vec.distance("a", "b").alias("d"), vec.similarity01("a", "b").alias("s"), vec.normalised("b").alias("n")).first()
    assert r.c == pytest.approx(math.sqrt(0.5)) and r.z == 0 and r.d == 1 and r.s == pytest.approx((1 + math.sqrt(0.5)) / 2) and r.n[0] == pytest.approx(math.sqrt(0.5))


def test_nearest(spark):
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, None), (10, [1.0])], "id long, e array<float>")
    q = spark.createDataFrame([(1, [4.0, 1.0]), (2, [0.0, 1.0])], "query_id int, q array<float>")
    got = search.nearest(q, corpus, "id", "e", 2).collect()
    assert {(r.query_id, r["rank"], r.id) for r in got} == {(1, 1, 4), (1, 2, 3), (2, 1, 0), (2, 2, 1)}
    assert search.nearest(q, corpus.limit(0), "id", "e", 2).count() == 0
    with pytest.raises(ValueError):
        search.small_side(corpus, 3)


def test_nearest_takes_more_queries_than_one_block(spark, monkeypatch):
    from corvine.plans import search_queries

    n = 2 * search.QUERIES_AT_ONCE + 1
    corpus = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(n)], "id long, e array<float>")
    q = corpus.selectExpr("id AS query_id", "e AS q").unionByName(spark.createDataFrame([(-1, [1.0])], "query_id long, q array<float>"))
    got = search.nearest(q, corpus, "id", "e", 1, "l2").collect()
    assert sorted((r.query_id, r.id, r.score) for r in got) == [(i, i, 0.0) for i in range(n)]
    monkeypatch.setattr(search_queries, "_vectors", lambda spark, base: corpus.selectExpr("id AS vec_id", "array(1 + e[0], 1f) AS embedding"))
    got = search_queries.QUERIES["f_nearest_every_100th"](spark, "").collect()
    assert {r.query_id for r in got} == set(range(0, n, 100)) and len(got) == 5 * len(range(0, n, 100))


DOCS = ["memory allocation error", "memory leak in kernel", "buffer overflow error", None, ""]


def test_bm25(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id long, text string")
    tf, dfreq, size = search.term_statistics(df.limit(3), "id", "text")
    assert {r.term: r.df for r in dfreq.collect()} == {"memory": 2, "allocation": 1, "error": 2, "leak": 1, "in": 1, "kernel": 1, "buffer": 1, "overflow": 1}
    assert size.first().mean_length == pytest.approx(10 / 3)
    got = {r.id: r.bm25 for r in search.bm25(df, "id", "text", ["overflow"]).collect()}
    assert len(got) == 5 and 0 < got[2] <= 1 and all(got[i] == 0 for i in (0, 1, 3, 4))
    assert all(r.bm25 == 0 for r in search.bm25(df, "id", "text", ["nowhere"]).collect())
    ranked = search.hybrid(df.withColumn("score", F.lit(0.5)), "id", "text", "overflow", 2).orderBy("rank").collect()
    assert [r.id for r in ranked] == [2, 0]
    assert [r.id for r in search.full_text(df, "id", "text", "errors", 5).collect()] == [0, 2]
    assert search.full_text(df, "id", "text", "the", 5).count() == 0


def test_line_chunks(spark):
    text = "\n".join(f"line {i}" for i in range(20))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x" * 100)], "id long, text string")
    got = search.line_chunks(df, "id", "text", 30, 10).orderBy("item", "chunk_index").collect()
    mine = [r for r in got if r.item == 1]
    assert mine[0].line_start == 1 and mine[-1].line_end == 20 and all(a.line_end >= b.line_start - 1 and b.line_start > a.line_start for a, b in zip(mine, mine[1:]))
    assert [len(r.chunk_text) for r in got if r.item == 4] == [100] and {r.item for r in got} == {1, 4}
    made = search.embed(df, "id", "text", lambda texts: [[3.0, 4.0] for _ in texts]).first()
    assert made.embedding == pytest.approx([0.6, 0.8])


def test_columns(spark):
    df = spark.createDataFrame([(["A", "B"], {"A": True, "B": False}), ([], {}), (["C"], {"A": True}), (None, None)], "need array<string>, ctx map<string,boolean>")
    assert [r.v for r in df.select(c.config_active("need", "ctx").alias("v")).collect()] == [False, True, False, True]
    assert one(spark, c.guard_holds("g", F.array(F.lit("CONFIG_A"))), g="!CONFIG_A") is False
    assert one(spark, c.guard_is_valid("g"), g="!CONFIG_A1") and not one(spark, c.guard_is_valid("g"), g="config_a")
    assert c.glob_to_like("a*b?_%") == "a%b_\\_\\%"
    levels = spark.createDataFrame([(["high", "low"],), ([],)], "l array<string>")
    assert [r.v for r in levels.select(c.path_confidence("l").alias("v")).collect()] == pytest.approx([0.45, 0.0])
    assert one(spark, c.nearest_rank(F.array(*map(F.lit, [5, 1, 3, 2, 4])), 0.5)) == 3


def test_path_confidence_of_all_calls(spark, monkeypatch):
    from corvine.plans import relational_queries as q

    levels = ["high"] * 4 + ["low", "medium", None]
    rows = [(i, "a.c", x) for i, x in enumerate(levels)] + [(10, "b.c", None), (11, None, "low")]
    monkeypatch.setattr(q.v, "edges", lambda spark, base: spark.createDataFrame(rows, "id long, file_path string, confidence string"))
    got = {r.file_path: tuple(r)[1:] for r in q.QUERIES["a_path_confidence_all"](spark, "").collect()}
    want = 0.9**4 * 0.5 * 0.7
    assert got == {"a.c": (6, round(want, 6), round(math.log(want), 6), 0.6, 0.95), "b.c": (0, 0.0, None, None, None)}


def test_statistics(spark):
    spans = spark.createDataFrame([("f", 10, 20), ("f", 15, 25), ("f", 26, 30), ("f", 40, None), ("f", None, 3), ("g", 5, 15)], "file string, a int, b int")
    got = {(r.file, r.start, r.end, r.n) for r in st.merge_spans(spans, ["file"], "a", "b").collect()}
    assert got == {("f", 10, 30, 3), ("f", 40, 40, 1), ("g", 5, 15, 1)}
    values = spark.createDataFrame([("x", i % 7) for i in range(40)] + [("x", None), ("y", 1)], "g string, v int")
    ranked = {r.g: r.v for r in st.nearest_rank(values, "g", "v", 0.95).collect()}
    assert ranked == {"x": sorted(i % 7 for i in range(40))[38], "y": 1}
    worst = st.worst_of(spark.createDataFrame([(1, "minor"), (1, "critical")], "id long, level string"), spark.createDataFrame([(1,), (2,)], "id long"), "id", "level", ["critical", "minor"], "none")
    assert {r.id: r.worst for r in worst.collect()} == {1: "critical", 2: "none"}
    assert [r.id for r in st.page(spark.range(25), ["id"], 10, 2).collect()] == [20, 21, 22, 23, 24]


def test_tables(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, ver int")
    new = spark.createDataFrame([(2, "c", 1), (1, "old", 0), (3, "d", 1), (3, "e", 2)], "id long, v string, ver int")
    assert {(r.id, r.v) for r in tables.upsert(base, new, ["id"], "ver").collect()} == {(1, "a"), (2, "c"), (3, "e")}
    assert {r.id for r in tables.insert_missing(base, new, ["id"]).collect()} == {1, 2, 3}
    assert tables.replace_groups(base, new.filter("id = 2"), ["id"]).count() == 2
    kids = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "kid long, parent long")
    parents, rest = tables.cascade(base, F.col("v") == "a", kids, "id", "parent")
    assert [r.id for r in parents.collect()] == [2] and {r.kid for r in rest.collect()} == {2, 3}
    diff = tables.snapshot_diff(base, new.filter("ver = 1"), "id", "v")
    assert {(r.id, r.change) for r in diff.collect()} == {(1, "deleted"), (2, "modified"), (3, "created")}
    log = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 3, 1)), (3, None)], "id long, ts timestamp")
    assert {r.id for r in tables.cleanup(log, "ts", "2024-03-02", 30).collect()} == {2, 3}
    assert [r.id for r in tables.anonymise(log, "ts", "2024-03-02", 30, ["id"]).orderBy("ts").collect()] == [3, None, 2]
    assert {r.step: r.n for r in tables.retention_report(log, "ts", "2024-03-02", {"a": 30, "b": 900}).collect()} == {"a": 1, "b": 0}


def test_replace_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "id long, part string")
    tables.replace_partitions(rows((1, "a"), (2, "b")), path, ["part"])
    tables.replace_partitions(rows((3, "b")), path, ["part"])
    assert {(r.id, r.part) for r in spark.read.parquet(path).collect()} == {(1, "a"), (3, "b")}


def test_impact(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (3, 1)], "src long, dst long")
    changed = spark.createDataFrame([(3,)], "node long")
    assert {r.node: r.distance for r in impact.affected(edges, changed).collect()} == {3: 0, 2: 1, 4: 1, 1: 2}
    assert {r.distance: r.n for r in impact.blast_radius(edges, changed, 1).collect()} == {0: 1, 1: 2}
    want = spark.createDataFrame([("f", "int f( int a ,int b );"), ("g", "int g(void)"), ("h", None)], "name string, signature string")
    have = spark.createDataFrame([("f", "int  f(int a, int b)"), ("g", None), ("x", "y")], "name string, signature string")
    assert [r.name for r in impact.signature_differences(want, have).collect()] == ["g"]
    assert {r.name for r in impact.signature_differences(want, have, strict=True).collect()} == {"f", "g"}
    assert [r.name for r in impact.missing_symbols(want, have).collect()] == ["h"] and [r.name for r in impact.unexpected_symbols(want, have).collect()] == ["x"]
    parts = have.filter("name = 'f'").select(impact.signature_parts("signature").alias("p")).first().p
    assert parts.returns == "int" and parts.parameters == ["int a", "int b"]
    diff = impact.call_differences(spark.createDataFrame([(1, 2), (1, 5)], "src long, dst long"), edges)
    assert {(r.src, r.dst, r.difference) for r in diff.collect()} == {(1, 5, "absent")}


def test_patches_and_interfaces(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    symbols = spark.createDataFrame([(1, "a", "int a(void)"), (2, "b", "int b(int x)"), (3, "c", None)], "id long, name string, signature string")
    changes = spark.createDataFrame([("c",), ("nobody",), ("c",)], "symbol string")
    assert {(r.name, r.distance) for r in impact.patch_impact(changes, symbols, edges).collect()} == {("c", 0), ("b", 1), ("a", 2)}
    want = spark.createDataFrame([("a", "void a(void)"), ("b", "int b(int x, int y)"), ("z", "int z()"), ("c", None)], "name string, signature string")
    assert {(r.name, r.problem) for r in impact.interface_breaks(want, symbols).collect()} == {("a", "returns"), ("b", "parameters"), ("z", "missing")}
    need = spark.createDataFrame([("r1", "CONFIG_A"), ("r2", "CONFIG_B"), ("r3", None)], "name string, option string")
    have = spark.createDataFrame([("CONFIG_A", "y"), ("CONFIG_B", "n")], "name string, value string")
    assert [r.name for r in impact.unmet_options(need, have).collect()] == ["r2"]


def test_pointers(spark):
    from corvine.operators import pointers

    text = "static struct file_operations f = { .read = my_read, .write = &my_write };\ndev->open = do_open;\nregister_thing(dev, my_cb);"
    df = spark.createDataFrame([(1, text), (2, None)], "id long, content string")
    got = {(r.how, r.pointer, r.function) for r in pointers.assignments(df, "id", "content").collect()}
    assert {("initialiser", "read", "my_read"), ("assignment", "open", "do_open"), ("registration", "register_thing", "my_cb")} <= got
    sym = spark.createDataFrame([(7, "my_read", "function")], "id long, name string, kind string")
    s = pointers.pointer_statistics(pointers.known_functions(pointers.assignments(df, "id", "content"), sym)).first()
    assert s.n_known == 1 and s.n_registrations == 1
    assert one(spark, pointers.purpose("p", "s"), p="x", s="timer_list") == "timer_handler" and one(spark, pointers.is_registration("p", "s"), p="my_ops", s="")


def test_streams(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    schema = "path string, hash string, ts timestamp"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / n))
    put("1", [("a", "1", t0), ("b", "1", t0), ("a", "2", t0 + timedelta(minutes=1))])
    got = []
    known = lambda: spark.createDataFrame([("b", "1")], "path string, hash string")
    handle = lambda df, n: got.extend(sorted((r.path, r.hash) for r in df.collect()))
    start = lambda: jobs.detect_changes(jobs.watch(spark, str(tmp_path / "in" / "*"), schema), "path", "hash", "ts", known, handle, str(tmp_path / "state")).awaitTermination()
    start()
    assert got == [("a", "2")]
    put("2", [("c", "9", t0)])
    start()
    assert got == [("a", "2"), ("c", "9")]  # what was seen isn't seen again
    jobs.drain_queue(jobs.watch(spark, str(tmp_path / "in" / "*"), schema), lambda df: df.groupBy("path").count(), str(tmp_path / "out"), str(tmp_path / "state2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    late = spark.createDataFrame([("x", "1", t0 + timedelta(minutes=m)) for m in (1, 5, 70, 200)], schema).coalesce(1)
    late.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))
    stats = jobs.windowed_statistics(stream.withColumn("v", F.col("hash").cast("int")), "ts", "path", "v", "1 hour", "10 minutes")
    jobs.to_folder(stats, str(tmp_path / "w"), str(tmp_path / "state3")).awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "w")).collect()) == [1, 2]
