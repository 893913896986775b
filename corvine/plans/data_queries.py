"""Queries of extraction, table changes, export, impact and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine.functions import columns
from corvine.operators import chunks, extraction, graph, impact, pointers, tables, work
from corvine.plans import views as v
from corvine.session import checkpoint_dir
from corvine.sources import config_files, csource, graph_files
from corvine.sources.tables import table
from corvine.streaming import jobs

NOW = "2001-08-01 00:00:00"


def _c_files(spark: SparkSession, base: str) -> DataFrame:
    return v.content(spark, base).filter("source_path LIKE '%.c' OR source_path LIKE '%.h'").select("id", "content")


def x_includes(spark: SparkSession, base: str) -> DataFrame:
    return csource.includes(_c_files(spark, base), "id", "content").groupBy("header").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_files"))


def x_macros(spark: SparkSession, base: str) -> DataFrame:
    found = csource.macros(_c_files(spark, base), "id", "content")
    return found.select("id", "name", F.size(F.coalesce("parameters", F.array().cast("array<string>"))).alias("n_parameters"), csource.macro_class("name").alias("class"))


def x_symbols(spark: SparkSession, base: str) -> DataFrame:
    return csource.symbol_rows(_c_files(spark, base), "id", "content")


def x_calls(spark: SparkSession, base: str) -> DataFrame:
    return csource.call_rows(_c_files(spark, base), "id", "content")


def x_call_statistics(spark: SparkSession, base: str) -> DataFrame:
    return x_calls(spark, base).groupBy("call_type", F.col("config_guard").isNotNull().alias("guarded")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("callee").alias("n_callees"))


def _kernel_texts(spark: SparkSession, base: str) -> DataFrame:
    """A source text per file, written from its symbols: a statement a line, of six kinds, behind the definition of a magic number."""
    s = v.symbols(spark, base).filter("name IS NOT NULL AND file_id IS NOT NULL")
    n = F.col("name")
    line = (
        F.when(F.col("id") % 6 == 0, F.concat(F.lit("EXPORT_SYMBOL_GPL("), n, F.lit(");")))
        .when(F.col("id") % 6 == 1, F.concat(F.lit("SYSCALL_DEFINE2("), n, F.lit(", int, fd, long, off) {")))
        .when(F.col("id") % 6 == 2, F.concat(F.lit("#define "), n, F.lit(" _IOW(DEMO_MAGIC, 5, struct arg)")))
        .when(F.col("id") % 6 == 3, F.concat(F.lit("static const struct file_operations "), n, F.lit("_fops = { .open = "), n, F.lit("_open, .release = &"), n, F.lit(" };")))
        .when(F.col("id") % 6 == 4, F.concat(F.lit("err = request_irq(irq, "), n, F.lit(", IRQF_SHARED, \"demo\", dev);")))
        .otherwise(F.concat(F.lit("dev->handler = "), n, F.lit(";")))
    )
    lines = s.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("t")))).alias("l"))  # the symbols of one file
    return lines.select(F.col("file_id").alias("id"), F.concat(F.lit("#define DEMO_MAGIC 'k'\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n")).alias("content"))


def x_patterns(spark: SparkSession, base: str) -> DataFrame:
    return extraction.patterns(_kernel_texts(spark, base), "id", "content")


def x_patterns_in_content(spark: SparkSession, base: str) -> DataFrame:
    """The same over the C files of the content, which hold none of the forms."""
    return extraction.patterns(_c_files(spark, base), "id", "content").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def x_entry_points(spark: SparkSession, base: str) -> DataFrame:
    return extraction.entry_points(_kernel_texts(spark, base), "id", "content").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("n_names"), F.sum("line").alias("lines"))


def x_ioctl_commands(spark: SparkSession, base: str) -> DataFrame:
    return extraction.ioctl_commands(_kernel_texts(spark, base), "id", "content")


def x_operation_tables(spark: SparkSession, base: str) -> DataFrame:
    return extraction.operation_tables(_kernel_texts(spark, base), "id", "content").drop("struct_type")


def x_assignments(spark: SparkSession, base: str) -> DataFrame:
    found = pointers.assignments(_kernel_texts(spark, base), "id", "content")
    return found.groupBy("how", "pointer").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("function").alias("n_functions"))


def x_pointers(spark: SparkSession, base: str) -> DataFrame:
    return pointers.known_functions(pointers.assignments(_c_files(spark, base), "id", "content"), v.symbols(spark, base)).groupBy("how", "pointer").agg(F.count(F.lit(1)).alias("n"), F.count("function_id").alias("n_known"))


def x_pointer_statistics(spark: SparkSession, base: str) -> DataFrame:
    return pointers.pointer_statistics(pointers.known_functions(pointers.assignments(_c_files(spark, base), "id", "content"), v.symbols(spark, base)))


def x_pointer_purpose(spark: SparkSession, base: str) -> DataFrame:
    """Callers of callbacks by purpose, from the names of function and file."""
    calls = v.edges(spark, base).filter("call_type = 'callback'")
    return calls.select(pointers.purpose("function_context", "file_path").alias("purpose"), pointers.is_registration("function_context", "file_path").alias("registers")).groupBy("purpose", "registers").agg(F.count(F.lit(1)).alias("n"))


def x_options(spark: SparkSession, base: str) -> DataFrame:
    names = table(spark, base, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"CONFIG_[A-Z0-9_]+"), F.lit(0)))).alias("option"))
    return names.groupBy("option").agg(F.count(F.lit(1)).alias("n_documents"))


def x_make_objects(spark: SparkSession, base: str) -> DataFrame:
    """Objects that Makefiles build, per option."""
    lines = config_files.lines_of(v.content(spark, base).filter("source_path LIKE '%.mk'"), "id", "content")
    rule = r"^obj-\$\((CONFIG_\w+)\)\s*\+?=\s*(\w+)\.o"
    rows = lines.filter(F.col("line").rlike(rule)).select("file", F.regexp_extract("line", rule, 1).alias("option"), F.regexp_extract("line", rule, 2).alias("object"))
    return rows.groupBy("option").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("object").alias("n_objects"))


def x_config_options(spark: SparkSession, base: str) -> DataFrame:
    """A configuration written as text from the guards of the calls, and read again."""
    names = table(spark, base, "call_edges").select(F.regexp_replace("config_guard", "^!", "").alias("o")).filter("o IS NOT NULL").distinct()
    n = F.length("o") % 5
    line = F.when(n == 0, F.concat("o", F.lit("=y"))).when(n == 1, F.concat("o", F.lit("=m"))).when(n == 2, F.concat(F.lit("# "), "o", F.lit(" is not set"))).when(n == 3, F.concat("o", F.lit('="text"'))).otherwise(F.concat("o", F.lit("=0x1f")))
    text = names.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("content")).select(F.lit(1).alias("id"), "content")  # one line per option
    return config_files.config_options(config_files.lines_of(text, "id", "content")).select("name", "type", "value")


def x_attributes(spark: SparkSession, base: str) -> DataFrame:
    """Signatures hold none of the attributes, the C files do."""
    marks = _c_files(spark, base).select("id", F.explode(csource.attributes("content")).alias("attribute"))
    return marks.groupBy("attribute").agg(F.count(F.lit(1)).alias("n"))


def x_syscall_names(spark: SparkSession, base: str) -> DataFrame:
    """Symbols under the prefixes that implementations of system calls have; one in five is left as it is."""
    s = v.symbols(spark, base)
    prefix = F.element_at(F.array(*map(F.lit, ("__se_sys_", "__do_sys_", "ksys_", "sys_", ""))), (F.pmod("id", F.lit(5)) + 1).cast("int"))
    return extraction.syscall_names(s.withColumn("name", F.concat(prefix, "name"))).select("id", "syscall")


def _orders(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice")


def u_upsert(spark: SparkSession, base: str) -> DataFrame:
    """The feed of versions folded into one row per source path."""
    rows = table(spark, base, "indexed_content").select("source_path", F.lower("content_hash").alias("content_hash"), "updated_at").distinct()
    early, late = rows.filter(F.dayofmonth("updated_at") % 2 == 1), rows.filter(F.dayofmonth("updated_at") % 2 == 0)
    merged = tables.upsert(tables.upsert(early.limit(0), early, ["source_path"], "updated_at"), late, ["source_path"], "updated_at")
    return merged.select("source_path", F.unix_micros("updated_at").alias("updated_us"))


def u_insert_missing(spark: SparkSession, base: str) -> DataFrame:
    o = _orders(spark, base)
    return tables.insert_missing(o.filter("o_orderstatus = 'F'"), o.filter("o_totalprice > 200000"), ["o_custkey"]).select("o_custkey").distinct()


def u_replace_groups(spark: SparkSession, base: str) -> DataFrame:
    o = _orders(spark, base)
    return tables.replace_groups(o, o.filter("o_totalprice > 400000"), ["o_custkey"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


def u_cascade(spark: SparkSession, base: str) -> DataFrame:
    _, lines = tables.cascade(_orders(spark, base), F.col("o_orderstatus") == "F", table(spark, base, "lineitem"), "o_orderkey", "l_orderkey")
    return lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def u_resolve_names(spark: SparkSession, base: str) -> DataFrame:
    """Calls recorded by name find the id of the name again; calls of unknown symbols are dropped."""
    named = v.symbols(spark, base).select(F.col("id").alias("callee_id"), F.col("name").alias("callee"))
    calls = v.edges(spark, base).select("id", "callee_id").join(named, "callee_id").select("id", F.when(F.col("id") % 7 == 0, F.lit("nobody")).otherwise(F.col("callee")).alias("callee"))
    return tables.resolve_names(calls, v.symbols(spark, base)).select("id", "callee_id")


def u_retention(spark: SparkSession, base: str) -> DataFrame:
    return tables.retention_report(_orders(spark, base), "o_orderdate", NOW, {"anonymise": 7, "results": 90, "vectors": 365})


def u_anonymise(spark: SparkSession, base: str) -> DataFrame:
    done = tables.anonymise(_orders(spark, base), "o_orderdate", NOW, 365, ["o_custkey"])
    return done.agg(F.count(F.lit(1)).alias("n"), F.count("o_custkey").alias("n_known"))


def u_cleanup(spark: SparkSession, base: str) -> DataFrame:
    days = F.when(F.col("o_orderstatus") == "F", 300).otherwise(900)
    return tables.cleanup(_orders(spark, base), "o_orderdate", NOW, days, F.col("o_totalprice") > 450000).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def u_defaults(spark: SparkSession, base: str) -> DataFrame:
    filled = tables.fill_defaults(v.files(spark, base), {"kernel_version": "unknown", "arch": "x86_64"})
    return filled.groupBy("kernel_version", "arch").agg(F.count(F.lit(1)).alias("n"))


def u_snapshot_diff(spark: SparkSession, base: str) -> DataFrame:
    """What a ledger knows against the current content."""
    known = table(spark, base, "content_ledger").filter("outcome = 'ok'").groupBy(F.col("content_id").alias("id")).agg(F.max(F.struct("processed_at", F.lower("content_hash").alias("h"))).alias("m")).select("id", F.col("m.h").alias("h"))
    now = v.content(spark, base).select("id", F.lower("content_hash").alias("h"))
    return tables.snapshot_diff(known, now, "id", "h")


def _nodes(spark: SparkSession, base: str) -> DataFrame:
    return v.symbols(spark, base).select("id", "name", F.col("kind").alias("type"))


def _links(spark: SparkSession, base: str) -> DataFrame:
    return v.edges(spark, base).filter("caller_id IS NOT NULL AND callee_id IS NOT NULL").select(F.col("caller_id").alias("source"), F.col("callee_id").alias("target"), F.col("call_type").alias("type"))


def e_json(spark: SparkSession, base: str) -> DataFrame:
    return graph_files.json_lines(_nodes(spark, base), _links(spark, base).distinct())


def e_json_round_trip(spark: SparkSession, base: str) -> DataFrame:
    nodes, edges = graph_files.read_json_lines(e_json(spark, base))
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes")).withColumn("n_edges", edges.agg(F.count(F.lit(1)).alias("n")).scalar())


def e_graphml(spark: SparkSession, base: str) -> DataFrame:
    return graph_files.graphml_lines(_nodes(spark, base), _links(spark, base).distinct())


def e_dot(spark: SparkSession, base: str) -> DataFrame:
    return graph_files.dot_lines(_nodes(spark, base), _links(spark, base).select("source", "target").distinct())


def e_edge_list(spark: SparkSession, base: str) -> DataFrame:
    return graph_files.edge_list(_links(spark, base))


def e_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Symbols of each configuration in chunks of at most 4,000 bytes of names."""
    rows = v.symbols(spark, base).filter("config IS NOT NULL").withColumn("bytes", F.octet_length("name"))
    cut = graph_files.cut_by_size(rows, "config", "id", "bytes", 4000)
    return cut.groupBy("config", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def e_manifest(spark: SparkSession, base: str) -> DataFrame:
    files = v.content(spark, base).filter("content IS NOT NULL").select(F.split_part("source_path", F.lit("/"), F.lit(4)).alias("top"), "id", "content")
    return graph_files.manifest(files, "top", "id", "content")


def e_verify(spark: SparkSession, base: str) -> DataFrame:
    """The first version of each item as declared against the current one; every tenth item isn't there."""
    rows = table(spark, base, "indexed_content").filter("content IS NOT NULL").select(F.col("id").alias("chunk_id"), "updated_at", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("checksum"))
    order = F.struct("updated_at", "checksum")
    side = lambda best: rows.groupBy("chunk_id").agg(best(F.struct("size_bytes", "checksum"), order).alias("x")).select("chunk_id", "x.size_bytes", "x.checksum")
    return graph_files.verify(side(F.min_by), side(F.max_by).filter("chunk_id % 10 <> 0"))


def e_compressed(spark: SparkSession, base: str) -> DataFrame:
    """Contents compressed, and restored from the payload."""
    docs = v.content(spark, base).filter("content IS NOT NULL").select("id", "content")
    packed = chunks.compressed(docs, "id", "content")
    back = chunks.restored(packed, "id", "payload").select("id", F.sha2("text", 256).alias("checksum"))
    return packed.select("id", "size_bytes", (F.col("ratio") < 1.5).alias("small")).join(back, "id")


def e_estimate(spark: SparkSession, base: str) -> DataFrame:
    return chunks.estimate(_nodes(spark, base), v.graph(spark, base))


def _sized(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    g = v.graph(spark, base)
    return g, chunks.by_size(v.symbols(spark, base).select(F.col("id").alias("node")), 500)


def e_size_chunks(spark: SparkSession, base: str) -> DataFrame:
    return _sized(spark, base)[1]


def e_reassembled(spark: SparkSession, base: str) -> DataFrame:
    """Chunks with their edges put together again."""
    g, parts = _sized(spark, base)
    checkpoint_dir(spark)
    built, boundary = chunks.build(parts.checkpoint(), g, v.symbols(spark, base).select(F.col("id").alias("node"), "name", "kind"))
    built, boundary = built.checkpoint(), boundary.checkpoint()
    nodes, edges = chunks.reassemble(built, boundary)
    names = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.min(F.get_json_object("attributes", "$.name")).alias("first_name"))
    one = lambda df, c: df.agg(F.count(F.lit(1)).alias(c)).scalar()
    return names.withColumns({"n_edges": one(edges, "n"), "n_boundary": one(boundary, "n"), "n_chunks": one(built, "n")})


def e_chunk_statistics(spark: SparkSession, base: str) -> DataFrame:
    """Statistics per configuration of the files as chunks."""
    size = v.symbols(spark, base).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.octet_length("name")).alias("size_bytes"))
    files = v.files(spark, base).select(F.col("id").alias("file_id"), "config")
    return chunks.export_statistics(size.join(files, "file_id").withColumn("n_edges", F.col("n_nodes") * 2), "config")


def e_identifiers(spark: SparkSession, base: str) -> DataFrame:
    return v.files(spark, base).select("id", chunks.stable_uuid("path", "config").alias("uuid")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uuid").alias("n_distinct"), F.bool_and(F.col("uuid").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-3[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}$")).alias("well_formed"))


def e_nested_json(spark: SparkSession, base: str) -> DataFrame:
    """A call as one JSON object with its two ends."""
    sym = v.symbols(spark, base)
    end = lambda side: sym.select(F.col("id").alias(f"{side}_id"), F.struct("name", "kind").alias(side))
    calls = v.edges(spark, base).select("id", "caller_id", "callee_id", "line_number").join(end("caller"), "caller_id").join(end("callee"), "callee_id")
    return calls.select("id", columns.as_json("line_number", "caller", "callee").alias("call"))


def u_reindex(spark: SparkSession, base: str) -> DataFrame:
    """Every C source asked for again: states and the vectors that are left."""
    docs = v.content(spark, base)
    done, left = work.reindex(docs, v.chunks(spark, base), F.lower("content_type") == "c_source", NOW)
    per = left.groupBy(F.col("content_id").alias("id")).agg(F.count(F.lit(1)).alias("n_vectors"))
    rows = done.join(per, "id", "left")
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("chunk_count").alias("n_chunks"), F.sum(F.coalesce("n_vectors", F.lit(0))).alias("n_vectors"))


def u_work(spark: SparkSession, base: str) -> DataFrame:
    """Items listed, a hundred claimed, every third fails, stuck ones are released."""
    docs = v.content(spark, base).select(F.col("id").cast("string").alias("chunk_id"))
    items = work.enlist(spark.createDataFrame([], "chunk_id string, status string, attempts int, changed_at timestamp"), docs)
    taken = work.claim(items, 100, NOW)
    ok = docs.filter("CAST(chunk_id AS BIGINT) % 2 = 0").select("chunk_id", (F.col("chunk_id").cast("long") % 3 > 0).alias("ok"))
    settled = work.settle(taken, ok, NOW, 1)
    return work.release(settled, "2001-08-01 01:00:00", 30).groupBy("status", "attempts").agg(F.count(F.lit(1)).alias("n"))


def u_cache(spark: SparkSession, base: str) -> DataFrame:
    """The query log as a cache of answers, asked again at one moment."""
    log = v.query_log(spark, base)
    row = log.select(work.query_key(F.concat_ws("  ", "query_type", (F.col("event_id") % 50).cast("string"))).alias("key"), (F.col("event_id") % 3).cast("string").alias("version"), F.col("event_id").cast("string").alias("answer"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"), F.lit(0).cast("long").alias("hits"))
    cache = work.with_answers(row.filter("CAST(answer AS BIGINT) % 2 = 0"), row.filter("CAST(answer AS BIGINT) % 2 = 1"))
    asked = row.select(F.col("answer").alias("query_id"), F.lower("key").alias("key"), F.when(F.col("version") > "0", F.col("version")).alias("version"))
    return work.cached(cache, asked, "2024-01-15 00:00:00")


def e_component_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Strongly connected components as chunks, and the number of edges that leave each."""
    g = v.graph(spark, base)
    comps = graph.components(g)
    across = graph.boundary_edges(g, comps.withColumnRenamed("component", "part"))
    sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))
    return sizes.join(across.groupBy(F.col("src_part").alias("component")).agg(F.count(F.lit(1)).alias("n_out")), "component", "left").select("component", "n_nodes", F.coalesce("n_out", F.lit(0)).alias("n_out"))


def e_node_page(spark: SparkSession, base: str) -> DataFrame:
    """The second page of 50 nodes and the edges that touch it."""
    nodes = _nodes(spark, base).orderBy("id").offset(50).limit(50).select("id")
    links = _links(spark, base).distinct()
    near = links.join(nodes.withColumnRenamed("id", "source"), "source", "left_semi").select("source", "target", "type").union(links.join(nodes.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "type"))
    return near.distinct()


def _changed(spark: SparkSession, base: str) -> DataFrame:
    return v.graph(spark, base).agg(F.max("dst").alias("node"))


def i_affected(spark: SparkSession, base: str) -> DataFrame:
    return impact.affected(v.graph(spark, base), _changed(spark, base), 3)


def i_blast_radius(spark: SparkSession, base: str) -> DataFrame:
    return impact.blast_radius(v.graph(spark, base), _changed(spark, base), 4)


def i_affected_files(spark: SparkSession, base: str) -> DataFrame:
    return impact.affected_files(i_affected(spark, base), v.symbols(spark, base))


def i_by_option(spark: SparkSession, base: str) -> DataFrame:
    return impact.by_option(v.edges(spark, base))


def _expected(spark: SparkSession, base: str) -> DataFrame:
    """Requirements made of the symbols: every fifth name is another, every third signature is set differently."""
    s = v.symbols(spark, base)
    name = F.when(F.col("id") % 5 == 0, F.concat("name", F.lit("_x"))).otherwise(F.col("name"))
    signature = F.when(F.col("id") % 3 == 0, F.regexp_replace("signature", r"\(", "( ")).when(F.col("id") % 3 == 1, F.concat(F.lit("static "), "signature")).otherwise(F.col("signature"))
    return s.select(name.alias("name"), signature.alias("signature"))


def d_missing(spark: SparkSession, base: str) -> DataFrame:
    return impact.missing_symbols(_expected(spark, base), v.symbols(spark, base)).select("name").distinct()


def d_unexpected(spark: SparkSession, base: str) -> DataFrame:
    return impact.unexpected_symbols(_expected(spark, base), v.symbols(spark, base)).select("id", "name")


def d_signatures(spark: SparkSession, base: str) -> DataFrame:
    found = impact.signature_differences(_expected(spark, base), v.symbols(spark, base))
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def d_calls(spark: SparkSession, base: str) -> DataFrame:
    """Expected are the calls as recorded in odd lines."""
    e = v.edges(spark, base).select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), "line_number", "call_type").filter("src IS NOT NULL AND dst IS NOT NULL")
    return impact.call_differences(e.filter("line_number % 2 = 1"), e.filter("call_type <> 'macro'"))


def _patches(spark: SparkSession, base: str) -> DataFrame:
    """A unified diff per file that renames its first ten symbols: each hunk has a context line, an old and a new one."""
    s = v.symbols(spark, base).filter("name IS NOT NULL AND start_line IS NOT NULL")
    first = Window.partitionBy("file_id").orderBy("id")
    few = s.withColumn("rn", F.row_number().over(first)).filter("rn <= 10")
    hunk = F.concat(F.lit("@@ -"), F.col("rn") * 10, F.lit(",2 +"), F.col("rn") * 10, F.lit(",2 @@\n // context\n-#define "), "name", F.lit(" 1\n+#define "), "name", F.lit("_new 1"))
    text = few.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("rn", hunk.alias("h")))).alias("h"))
    path = v.files(spark, base).select(F.col("id").alias("file_id"), "path")
    return text.join(path, "file_id").select(F.col("file_id").alias("id"), F.concat(F.lit("--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n"), F.array_join(F.transform("h", lambda x: x["h"]), "\n")).alias("content"))


def x_diff_lines(spark: SparkSession, base: str) -> DataFrame:
    found = config_files.diff_lines(config_files.lines_of(_patches(spark, base), "id", "content"))
    return found.select("file", "n", "path", "sign", "new_line", "text")


def x_changed_symbols(spark: SparkSession, base: str) -> DataFrame:
    return config_files.changed_symbols(config_files.diff_lines(config_files.lines_of(_patches(spark, base), "id", "content"))).select("file", "symbol", "kind", "change")


def i_patch(spark: SparkSession, base: str) -> DataFrame:
    """Whom the patches of every fiftieth file reach within one call."""
    part = _patches(spark, base).filter("id % 50 = 0")
    changed = config_files.changed_symbols(config_files.diff_lines(config_files.lines_of(part, "id", "content"))).filter("change = 'removed'")
    return impact.patch_impact(changed, v.symbols(spark, base), v.graph(spark, base), 1)


def x_kconfig(spark: SparkSession, base: str) -> DataFrame:
    """A Kconfig text written from the guards of the calls, and read again."""
    names = table(spark, base, "call_edges").select(F.regexp_replace("config_guard", "^!?CONFIG_", "").alias("o")).filter("o IS NOT NULL").distinct()
    kind = F.when(F.length("o") % 2 == 0, "bool").otherwise("tristate")
    block = F.concat(F.lit("config "), "o", F.lit("\n\t"), kind, F.lit(' "the option"\n\tdepends on NET && PCI\n\tdefault y\n\thelp\n\t  Turns '), "o", F.lit(" on.\n"))
    text = names.agg(F.array_join(F.array_sort(F.collect_list(block)), "\n").alias("content")).select(F.lit(1).alias("id"), "content")  # one block an option
    found = config_files.kconfig_options(config_files.lines_of(text, "id", "content"))
    return found.select("name", "type", "default", F.array_join("depends", "+").alias("depends"), "help")


def d_options(spark: SparkSession, base: str) -> DataFrame:
    """Callers that need an option which is off; on are those with an even length."""
    e = v.edges(spark, base).filter("config_guard IS NOT NULL").select(F.col("caller_id").cast("string").alias("name"), F.regexp_replace("config_guard", "^!", "").alias("option"))
    options = e.select(F.col("option").alias("name"), F.when(F.length("option") % 2 == 0, "y").otherwise("n").alias("value")).distinct()
    return impact.unmet_options(e, options).groupBy("option").agg(F.count(F.lit(1)).alias("n"))


def d_interfaces(spark: SparkSession, base: str) -> DataFrame:
    return impact.interface_breaks(_expected(spark, base), v.symbols(spark, base)).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def e_graphml_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """Written as GraphML and read by Spark's XML reader."""
    folder = f"{checkpoint_dir(spark)}/graphml-{uuid.uuid4().hex}"
    graph_files.graphml_documents(e_graphml(spark, base)).write.text(folder)
    nodes, edges = graph_files.read_graphml(spark, folder)
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name")).withColumn("n_edges", edges.agg(F.count(F.lit(1)).alias("n")).scalar())


def t_changes(spark: SparkSession, base: str) -> DataFrame:
    """The feed of versions as a stream; what differs from the ledger goes on, under the number of its batch."""
    folder = f"{checkpoint_dir(spark)}/changes-{uuid.uuid4().hex}"
    schema = table(spark, base, "indexed_content").schema
    feed = spark.readStream.schema(schema).parquet(f"{base}/indexed_content.parquet*").select("id", F.lower("content_hash").alias("content_hash"), "updated_at")
    known = lambda: table(spark, base, "content_ledger").select(F.col("content_id").alias("id"), F.lower("content_hash").alias("content_hash")).distinct()
    handle = lambda changed, number: changed.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
    query = jobs.detect_changes(feed, "id", "content_hash", "updated_at", known, handle, f"{folder}/state")
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.parquet(f"{folder}/out").groupBy("id").agg(F.max_by("content_hash", F.struct("updated_at", "content_hash")).alias("content_hash"))


def t_windows(spark: SparkSession, base: str) -> DataFrame:
    """Hourly statistics by a stream that runs to its end; open windows aren't written."""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, base, "events").schema).parquet(f"{base}/events.parquet*")
    stats = jobs.windowed_statistics(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", "1 hour", "10 minutes")
    query = jobs.to_folder(stats, f"{folder}/out", f"{folder}/state")
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    out = spark.read.parquet(f"{folder}/out")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("mean", 6).alias("mean"))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__name__", "")[:2] in ("x_", "u_", "e_", "i_", "d_", "t_")}

_CFILE = "cf AS (SELECT id, content FROM doc WHERE source_path LIKE '%.c' OR source_path LIKE '%.h')"
_O = "o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_totalprice FROM orders)"
_LINK = "link AS (SELECT caller_id AS source, callee_id AS target, call_type AS type FROM edge WHERE caller_id IS NOT NULL AND callee_id IS NOT NULL)"
_REACH = "r(node, depth) AS (SELECT (SELECT max(dst) FROM g), 0 UNION SELECT g.src, r.depth + 1 FROM r JOIN g ON g.dst = r.node WHERE r.depth < {0}), lv AS (SELECT node, min(depth) AS distance FROM r GROUP BY node)"
_EXPECTED = """ex AS (SELECT CASE WHEN id % 5 = 0 THEN name || '_x' ELSE name END AS name,
  CASE WHEN id % 3 = 0 THEN regexp_replace(signature, '\\(', '( ', 'g') WHEN id % 3 = 1 THEN 'static ' || signature ELSE signature END AS signature FROM sym)"""
_NORM = "regexp_replace(regexp_replace(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '\\s*([(),*])\\s*', '\\1', 'g'), ';$', '')"

# Line 1 defines the magic number; the symbols follow in the order of their ids.
_KERNEL = "k AS (SELECT id, file_id, name, (1 + row_number() OVER (PARTITION BY file_id ORDER BY id))::INTEGER AS line FROM sym WHERE name IS NOT NULL AND file_id IS NOT NULL)"

_PATCH = """few AS (SELECT file_id, name, row_number() OVER (PARTITION BY file_id ORDER BY id) AS rn FROM sym WHERE name IS NOT NULL AND start_line IS NOT NULL),
pf AS (SELECT file_id, path, name, rn FROM few JOIN file ON file.id = few.file_id WHERE rn <= 10)"""

SQL = {
    "x_diff_lines": v.with_(v.SYM, v.FILE, _PATCH) + """
SELECT file_id AS file, (4 * rn + k)::INTEGER AS n, path, CASE k WHEN 1 THEN '-' WHEN 2 THEN '+' ELSE ' ' END AS sign, (rn * 10 + CASE k WHEN 0 THEN 0 ELSE 1 END)::INTEGER AS new_line,
  CASE k WHEN 0 THEN '// context' WHEN 1 THEN '#define ' || name || ' 1' ELSE '#define ' || name || '_new 1' END AS text FROM pf, (VALUES (0), (1), (2)) t(k)""",
    "x_changed_symbols": v.with_(v.SYM, v.FILE, _PATCH) + "SELECT file_id AS file, name AS symbol, 'macro' AS kind, 'removed' AS change FROM pf UNION ALL SELECT file_id, name || '_new', 'macro', 'added' FROM pf",
    "i_patch": v.with_(v.SYM, v.FILE, v.GRAPH, _PATCH) + """
, c AS (SELECT DISTINCT sym.id AS node FROM sym JOIN pf ON pf.name = sym.name WHERE pf.file_id % 50 = 0), r AS (SELECT node, 0 AS d FROM c UNION ALL SELECT g.src, 1 FROM c JOIN g ON g.dst = c.node), m AS (SELECT node, min(d)::INTEGER AS distance FROM r GROUP BY 1)
SELECT sym.name, m.node, m.distance FROM m LEFT JOIN sym ON sym.id = m.node""",
    "x_kconfig": """
WITH o AS (SELECT DISTINCT regexp_replace(config_guard, '^!?CONFIG_', '') AS name FROM call_edges WHERE config_guard IS NOT NULL)
SELECT name, CASE WHEN length(name) % 2 = 0 THEN 'bool' ELSE 'tristate' END AS type, 'y' AS "default", 'NET+PCI' AS depends, 'Turns ' || name || ' on.' AS help FROM o WHERE regexp_matches(name, '^\\w+$')""",
    "d_options": v.with_(v.EDGE) + "SELECT regexp_replace(config_guard, '^!', '') AS option, count(*) AS n FROM edge WHERE length(regexp_replace(config_guard, '^!', '')) % 2 = 1 GROUP BY 1",
    "e_graphml_round_trip": v.with_(v.SYM, v.EDGE, _LINK) + "SELECT coalesce(kind, 'Function') AS type, count(*) AS n, min(name) AS first_name, (SELECT count(*) FROM (SELECT DISTINCT * FROM link)) AS n_edges FROM sym GROUP BY 1",
    "t_changes": v.with_(v.DOC) + "SELECT id, lower(content_hash) AS content_hash FROM doc WHERE (id, lower(content_hash)) NOT IN (SELECT (content_id, lower(content_hash)) FROM content_ledger)",
    "x_includes": v.with_(v.DOC, _CFILE) + """
, h AS (SELECT id, unnest(regexp_extract_all(content, '(?m)^[ \\t]*#[ \\t]*include[ \\t]*[<"]([^>"\\n]+)[>"]', 1)) AS header FROM cf)
SELECT header, count(*) AS n, count(DISTINCT id) AS n_files FROM h GROUP BY 1""",
    "x_patterns": v.with_(v.SYM, _KERNEL) + """
SELECT file_id AS id, CASE id % 6 WHEN 0 THEN 'export' WHEN 1 THEN 'syscall' WHEN 2 THEN 'ioctl_command' ELSE 'interrupt' END AS kind, name,
  CASE id % 6 WHEN 0 THEN '_GPL' WHEN 1 THEN '2' WHEN 2 THEN '_IOW' ELSE 'request_irq' END AS detail, line FROM k WHERE id % 6 IN (0, 1, 2, 4)
UNION ALL SELECT file_id, 'interrupt_flag', 'IRQF_SHARED', NULL, line FROM k WHERE id % 6 = 4""",
    "x_entry_points": v.with_(v.SYM, _KERNEL) + """
, e AS (SELECT 'syscall' AS kind, name, line FROM k WHERE id % 6 = 1 UNION ALL SELECT 'interrupt', name, line FROM k WHERE id % 6 = 4
  UNION ALL SELECT 'file_operation', name || '_open', line FROM k WHERE id % 6 = 3 UNION ALL SELECT 'file_operation', name, line FROM k WHERE id % 6 = 3)
SELECT kind, count(*) AS n, count(DISTINCT name) AS n_names, sum(line)::BIGINT AS lines FROM e GROUP BY 1""",
    "x_ioctl_commands": v.with_(v.SYM, _KERNEL) + "SELECT file_id AS id, name, 'write' AS direction, 'k' AS magic, '5' AS number, 'struct arg' AS argument, line FROM k WHERE id % 6 = 2",
    "x_operation_tables": v.with_(v.SYM, _KERNEL) + """
SELECT file_id AS id, name || '_fops' AS table_name, 'open' AS field, name || '_open' AS "function", line FROM k WHERE id % 6 = 3
UNION ALL SELECT file_id, name || '_fops', 'release', name, line FROM k WHERE id % 6 = 3""",
    "x_assignments": v.with_(v.SYM, _KERNEL) + """
SELECT 'assignment' AS how, 'handler' AS pointer, count(*) AS n, count(DISTINCT name) AS n_functions FROM k WHERE id % 6 = 5
UNION ALL SELECT 'initialiser', unnest(['open', 'release']), count(*), count(DISTINCT name) FROM k WHERE id % 6 = 3""",
    "x_pointer_purpose": v.with_(v.EDGE) + "SELECT CASE "
    + " ".join(f"WHEN contains(lower(function_context), '{w}') OR coalesce(contains(lower(file_path), '{w}'), false) THEN '{n}'" for w, n in pointers.PURPOSE)
    + " ELSE 'generic_callback' END AS purpose, "
    + " OR ".join(f"contains(lower(function_context), '{w}') OR coalesce(contains(lower(file_path), '{w}'), false)" for w in pointers.REGISTRATION)
    + " AS registers, count(*) AS n FROM edge WHERE call_type = 'callback' GROUP BY 1, 2",
    "x_options": "WITH o AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, 'CONFIG_[A-Z0-9_]+'))) AS option FROM documents) SELECT option, count(*) AS n_documents FROM o GROUP BY 1",
    "x_make_objects": v.with_(v.DOC) + """
, l AS (SELECT unnest(regexp_split_to_array(content, '\\r?\\n')) AS line FROM doc WHERE source_path LIKE '%.mk'),
r AS (SELECT regexp_extract(line, '^obj-\\$\\((CONFIG_\\w+)\\)\\s*\\+?=\\s*(\\w+)\\.o', 1) AS option, regexp_extract(line, '^obj-\\$\\((CONFIG_\\w+)\\)\\s*\\+?=\\s*(\\w+)\\.o', 2) AS object FROM l)
SELECT option, count(*) AS n, count(DISTINCT object) AS n_objects FROM r WHERE option <> '' GROUP BY 1""",
    "x_config_options": """
WITH o AS (SELECT DISTINCT regexp_replace(config_guard, '^!', '') AS name FROM call_edges WHERE config_guard IS NOT NULL)
SELECT name, CASE length(name) % 5 WHEN 0 THEN 'tristate' WHEN 1 THEN 'module' WHEN 2 THEN 'not_set' WHEN 3 THEN 'string' ELSE 'hex' END AS type,
  CASE length(name) % 5 WHEN 0 THEN 'y' WHEN 1 THEN 'm' WHEN 2 THEN NULL WHEN 3 THEN 'text' ELSE '0x1f' END AS value FROM o WHERE regexp_matches(name, '^CONFIG_\\w+$')""",
    "x_attributes": v.with_(v.DOC, _CFILE) + f"SELECT a AS attribute, count(*) AS n FROM cf JOIN (SELECT unnest({csource.ATTRIBUTES}) AS a) ON contains(content, a) GROUP BY 1",
    "x_syscall_names": v.with_(v.SYM) + "SELECT id, name AS syscall FROM sym WHERE id % 5 < 4",
    "u_upsert": "SELECT source_path, epoch_us(max(updated_at)) AS updated_us FROM indexed_content GROUP BY 1",
    "u_insert_missing": "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 200000",
    "u_replace_groups": "SELECT o_custkey, CASE WHEN count(CASE WHEN o_totalprice > 400000 THEN 1 END) > 0 THEN count(CASE WHEN o_totalprice > 400000 THEN 1 END) ELSE count(*) END AS n FROM orders GROUP BY 1",
    "u_cascade": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "u_resolve_names": v.with_(v.EDGE, v.SYM) + ", n AS (SELECT name, min(id) AS i FROM sym GROUP BY 1) SELECT edge.id, n.i AS callee_id FROM edge JOIN sym ON sym.id = edge.callee_id JOIN n ON n.name = sym.name WHERE edge.id % 7 <> 0",
    "u_reindex": v.with_(v.DOC, v.CHUNK) + """
, d AS (SELECT id, coalesce(lower(content_type) = 'c_source', false) AND coalesce(status, 'PENDING') <> 'PROCESSING' AS hit, status, chunk_count FROM doc),
c AS (SELECT content_id AS id, count(*) AS n FROM chunk WHERE content_id NOT IN (SELECT id FROM d WHERE hit) GROUP BY 1)
SELECT CASE WHEN hit THEN 'PENDING' ELSE status END AS status, count(*) AS n, sum(CASE WHEN hit THEN 0 ELSE chunk_count END)::BIGINT AS n_chunks, sum(coalesce(c.n, 0))::BIGINT AS n_vectors FROM d LEFT JOIN c USING (id) GROUP BY 1""",
    "u_work": v.with_(v.DOC) + """
, i AS (SELECT id::VARCHAR AS c, id, row_number() OVER (ORDER BY id::VARCHAR) <= 100 AS taken FROM doc),
r AS (SELECT CASE WHEN NOT taken THEN 'PENDING' WHEN id % 2 = 0 AND id % 3 > 0 THEN 'COMPLETED' WHEN id % 2 = 0 THEN 'FAILED' ELSE 'PENDING' END AS status, CASE WHEN taken THEN 1 ELSE 0 END AS attempts FROM i)
SELECT status, attempts, count(*) AS n FROM r GROUP BY 1, 2""",
    "u_cache": v.with_(v.LOG) + """
, r AS (SELECT sha256(lower(query_type || ' ' || (event_id % 50))) AS key, event_id % 3 AS version, event_id, ts FROM log),
c AS (SELECT key, version, arg_max(event_id, (ts, event_id::VARCHAR)) AS answer, max(ts) AS t FROM r GROUP BY 1, 2), l AS (SELECT * FROM c WHERE t + INTERVAL 24 HOURS > TIMESTAMP '2024-01-15')
SELECT r.event_id::VARCHAR AS query_id, arg_max(l.answer::VARCHAR, (l.t, l.answer::VARCHAR)) AS answer FROM r JOIN l ON l.key = r.key AND (r.version = 0 OR l.version = r.version) GROUP BY 1""",
    "u_retention": "SELECT step, count(CASE WHEN o_orderdate < TIMESTAMP '2001-08-01' - to_days(d) THEN 1 END) AS n FROM orders, (VALUES ('anonymise', 7), ('results', 90), ('vectors', 365)) s(step, d) GROUP BY 1",
    "u_anonymise": "SELECT count(*) AS n, count(CASE WHEN o_orderdate < TIMESTAMP '2001-08-01' - to_days(365) THEN NULL ELSE o_custkey END) AS n_known FROM orders",
    "u_cleanup": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT o_orderdate < TIMESTAMP '2001-08-01' - to_days(CASE WHEN o_orderstatus = 'F' THEN 300 ELSE 900 END) OR o_totalprice > 450000 GROUP BY 1",
    "u_defaults": v.with_(v.FILE) + "SELECT coalesce(kernel_version, 'unknown') AS kernel_version, coalesce(arch, 'x86_64') AS arch, count(*) AS n FROM file GROUP BY 1, 2",
    "u_snapshot_diff": v.with_(v.DOC) + """
, k AS (SELECT content_id AS id, arg_max(lower(content_hash), (processed_at, lower(content_hash))) AS h FROM content_ledger WHERE outcome = 'ok' GROUP BY 1)
SELECT coalesce(doc.id, k.id) AS id, CASE WHEN k.id IS NULL THEN 'created' WHEN doc.id IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM k FULL JOIN doc ON doc.id = k.id WHERE k.id IS NULL OR doc.id IS NULL OR lower(doc.content_hash) <> k.h""",
    "e_json_round_trip": v.with_(v.SYM, v.EDGE, _LINK) + "SELECT (SELECT count(*) FROM sym) AS n_nodes, (SELECT count(*) FROM (SELECT DISTINCT * FROM link WHERE source IN (SELECT id FROM sym) AND target IN (SELECT id FROM sym))) AS n_edges",
    "e_dot": v.with_(v.SYM, v.EDGE, _LINK) + """
SELECT 0 AS part, '  n' || id || ' [label="' || name || '"];' AS value FROM sym UNION ALL SELECT DISTINCT 1, '  n' || source || ' -> n' || target || ';' FROM link""",
    "e_graphml": v.with_(v.SYM, v.EDGE, _LINK) + """
SELECT 0 AS part, '<node id="n' || id || '"><data key="d0">' || name || '</data><data key="d1">' || coalesce(kind, 'Function') || '</data></node>' AS value FROM sym
UNION ALL SELECT DISTINCT 1, '<edge source="n' || source || '" target="n' || target || '"><data key="d2">' || coalesce(type, 'Direct') || '</data></edge>' FROM link""",
    "e_edge_list": v.with_(v.EDGE, _LINK) + "SELECT source, target, coalesce(type, 'Direct') AS type, count(*) AS weight FROM link GROUP BY 1, 2, 3",
    "e_manifest": v.with_(v.DOC) + """
, f AS (SELECT split_part(source_path, '/', 4) AS top, id, content FROM doc WHERE content IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY top ORDER BY id) AS sequence FROM f)
SELECT printf('%s_%03d', replace(top, '/', '_'), sequence) AS chunk_id, sequence, strlen(content) AS size_bytes, sha256(content) AS checksum FROM n""",
    "e_verify": """
WITH c AS (SELECT id, updated_at, strlen(content) AS n, sha256(content) AS h FROM indexed_content WHERE content IS NOT NULL),
f AS (SELECT id, arg_min((n, h), (updated_at, h)) AS a, arg_max((n, h), (updated_at, h)) AS b FROM c GROUP BY 1)
SELECT id AS chunk_id, CASE WHEN id % 10 = 0 THEN 'missing' WHEN a[1] <> b[1] THEN 'size' ELSE 'checksum' END AS problem FROM f WHERE id % 10 = 0 OR a <> b""",
    "e_compressed": v.with_(v.DOC) + "SELECT id, strlen(content) AS size_bytes, CASE WHEN strlen(content) > 0 THEN true END AS small, sha256(content) AS checksum FROM doc WHERE content IS NOT NULL",
    "e_estimate": v.with_(v.SYM, v.GRAPH) + ", c AS (SELECT (SELECT count(*) FROM sym) AS n, (SELECT count(*) FROM g) AS m) SELECT n AS n_nodes, m AS n_edges, greatest(ceil(n / 1000), ceil(m / 5000), 1)::BIGINT AS n_chunks FROM c",
    "e_size_chunks": v.with_(v.SYM) + "SELECT id AS node, (row_number() OVER (ORDER BY id) - 1) // 500 AS part FROM sym",
    "e_reassembled": v.with_(v.SYM, v.GRAPH, "p AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 500 AS part FROM sym)", "b AS (SELECT a.part AS x, c.part AS y FROM g JOIN p a ON a.id = g.src JOIN p c ON c.id = g.dst)")
    + "SELECT (SELECT count(*) FROM sym) AS n_nodes, (SELECT min(name) FROM sym) AS first_name, (SELECT count(*) FROM b) AS n_edges, (SELECT count(*) FROM b WHERE x <> y) AS n_boundary, (SELECT max(part) + 1 FROM p) AS n_chunks",
    "e_chunk_statistics": v.with_(v.SYM, v.FILE) + """
, z AS (SELECT file_id, count(*) AS n, sum(strlen(name))::BIGINT AS s FROM sym GROUP BY 1)
SELECT config, '{"total_chunks":' || count(*) || ',"total_size_bytes":' || sum(s)::BIGINT || ',"total_nodes":' || sum(n)::BIGINT || ',"total_edges":' || 2 * sum(n)::BIGINT || ',"avg_chunk_size":' || round(avg(s))::BIGINT || '}' AS statistics
FROM z JOIN file ON file.id = z.file_id GROUP BY 1""",
    "e_identifiers": v.with_(v.FILE) + "SELECT count(*) AS n, count(DISTINCT (path, config)) AS n_distinct, true AS well_formed FROM file",
    "e_nested_json": v.with_(v.SYM, v.EDGE) + """
SELECT e.id, '{' || CASE WHEN line_number IS NULL THEN '' ELSE '"line_number":' || line_number || ',' END || '"caller":{"name":"' || a.name || '","kind":"' || a.kind || '"},"callee":{"name":"' || b.name || '","kind":"' || b.kind || '"}}' AS call
FROM edge e JOIN sym a ON a.id = e.caller_id JOIN sym b ON b.id = e.callee_id""",
    "e_node_page": v.with_(v.SYM, v.EDGE, _LINK) + ", p AS (SELECT id FROM sym ORDER BY id LIMIT 50 OFFSET 50) SELECT DISTINCT source, target, type FROM link WHERE source IN (SELECT id FROM p) OR target IN (SELECT id FROM p)",
    "i_affected": v.with_(v.GRAPH, _REACH.format(3), recursive=True) + "SELECT node, distance FROM lv",
    "i_blast_radius": v.with_(v.GRAPH, _REACH.format(4), recursive=True) + "SELECT distance, count(*) AS n FROM lv GROUP BY 1",
    "i_affected_files": v.with_(v.SYM, v.GRAPH, _REACH.format(3), recursive=True) + "SELECT file_id, count(*) AS n_symbols, min(distance) AS nearest FROM lv JOIN sym ON sym.id = lv.node GROUP BY 1",
    "i_by_option": v.with_(v.EDGE) + "SELECT regexp_replace(config_guard, '^!', '') AS option, count(*) AS n_edges, count(DISTINCT caller_id) AS n_callers FROM edge WHERE config_guard IS NOT NULL GROUP BY 1",
    "d_missing": v.with_(v.SYM, _EXPECTED) + "SELECT DISTINCT name FROM ex WHERE name NOT IN (SELECT name FROM sym)",
    "d_unexpected": v.with_(v.SYM, _EXPECTED) + "SELECT id, name FROM sym WHERE name NOT IN (SELECT name FROM ex)",
    "d_signatures": v.with_(v.SYM, _EXPECTED) + f", p AS (SELECT DISTINCT ex.name, ex.signature AS e, sym.signature AS a FROM ex JOIN sym USING (name) WHERE ex.signature IS NOT NULL AND ({_NORM.format('ex.signature')} IS DISTINCT FROM {_NORM.format('sym.signature')})) SELECT name, count(*) AS n FROM p GROUP BY 1",
    "d_calls": v.with_(v.EDGE) + """
, e AS (SELECT caller_id AS src, callee_id AS dst, line_number, call_type FROM edge WHERE caller_id IS NOT NULL AND callee_id IS NOT NULL),
w AS (SELECT DISTINCT src, dst FROM e WHERE line_number % 2 = 1), h AS (SELECT DISTINCT src, dst FROM e WHERE call_type <> 'macro' AND src IN (SELECT src FROM w))
SELECT *, 'absent' AS difference FROM (SELECT * FROM w EXCEPT SELECT * FROM h) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM h EXCEPT SELECT * FROM w)""",
    "t_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2",
}
