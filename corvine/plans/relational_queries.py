"""Filters, joins, aggregates, windows and set operations over the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine.functions import columns as c
from corvine.operators import statistics as st
from corvine.plans import views as v
from corvine.sources.tables import table


def r_equality_in(spark: SparkSession, base: str) -> DataFrame:
    keep = c.all_of(c.equals_if("kind", "function"), c.equals_if("config", None), F.col("config").isin("x86_64:defconfig", "x86_64:allmod"))
    return v.symbols(spark, base).filter(keep).select("id", "name")


def r_confidence_at_least(spark: SparkSession, base: str) -> DataFrame:
    return v.edges(spark, base).filter(c.confidence_at_least("confidence", "medium")).select("id", "confidence")


def r_guard_or_none(spark: SparkSession, base: str) -> DataFrame:
    first = table(spark, base, "call_edges").agg(F.min("config_guard").alias("g"))
    kept = v.edges(spark, base).filter(c.null_or_equal("config_guard", first.scalar()))
    return kept.groupBy("config_guard").agg(F.count(F.lit(1)).alias("n"))


def r_name_search(spark: SparkSession, base: str) -> DataFrame:
    found = v.symbols(spark, base).filter(F.col("name").ilike("%RING%"))
    return found.select("id", "name", F.coalesce("signature", F.concat("name", F.lit(" ("), "kind", F.lit(")"))).alias("signature"), F.lit(0.95).alias("score"))


def r_path_patterns(spark: SparkSession, base: str) -> DataFrame:
    keep = c.like_any("path", c.fold_glob(["drivers/*", "net/*_?.c"])) & ~F.col("path").like("%\\_1%")
    return v.files(spark, base).filter(keep).select("id", "path")


def r_subsystem_counts(spark: SparkSession, base: str) -> DataFrame:
    bucket = F.when(F.col("path").startswith("drivers/"), "drivers").when(F.col("path").startswith("net/"), "net").when(F.col("path").startswith("fs/"), "fs").otherwise("other")
    return v.files(spark, base).groupBy(bucket.alias("subsystem")).agg(F.count(F.lit(1)).alias("n"))


def r_config_active(spark: SparkSession, base: str) -> DataFrame:
    """Edges whose guards hold where the options with an even length of name are on."""
    guards = v.edges(spark, base).select("id", F.array_compact(F.array(F.regexp_replace("config_guard", "^!", ""))).alias("needed"))
    options = table(spark, base, "call_edges").select(F.regexp_replace("config_guard", "^!", "").alias("o")).filter("o IS NOT NULL").distinct()
    context = options.agg(F.map_from_entries(F.collect_list(F.struct("o", (F.length("o") % 2 == 0).alias("on")))).alias("m"))  # one entry per option
    return guards.withColumn("context", context.scalar()).withColumn("active", c.config_active("needed", "context")).groupBy("active").agg(F.count(F.lit(1)).alias("n"))


def r_guard_syntax(spark: SparkSession, base: str) -> DataFrame:
    odd = v.edges(spark, base).filter("config_guard IS NOT NULL").withColumn("valid", c.guard_is_valid("config_guard"))
    agree = F.coalesce(F.col("conditional"), F.lit(False))
    return odd.groupBy("valid", agree.alias("conditional")).agg(F.count(F.lit(1)).alias("n"))


def r_chunks_without_content(spark: SparkSession, base: str) -> DataFrame:
    """Chunks of items that no row of completed content stands for."""
    ids = v.content(spark, base).filter("status = 'COMPLETED'").select(F.col("id").alias("content_id"))
    return v.chunks(spark, base).join(ids, "content_id", "left_anti").select("id", "content_id")


def r_chunks_of_failed(spark: SparkSession, base: str) -> DataFrame:
    failed = v.content(spark, base).filter("status = 'FAILED'").select(F.col("id").alias("content_id"))
    return v.chunks(spark, base).join(failed, "content_id", "left_semi").select("id", "content_id")


def r_metadata_fields(spark: SparkSession, base: str) -> DataFrame:
    """Fields of the JSON texts; broken JSON counts as such."""
    j = v.edges(spark, base).filter("metadata IS NOT NULL").select(F.try_parse_json("metadata").alias("j"))
    fields = j.select(F.col("j").isNull().alias("broken"), F.expr("try_variant_get(j, '$.pass', 'int')").alias("pass"), F.expr("try_variant_get(j, '$.src', 'string')").alias("src"))
    return fields.groupBy("broken", "pass", "src").agg(F.count(F.lit(1)).alias("n"))


def r_guard_holds(spark: SparkSession, base: str) -> DataFrame:
    """Edges whose guard, negated or not, holds where two options are on."""
    enabled = F.array(F.lit("CONFIG_NET"), F.regexp_replace("first", "^!", ""))
    first = table(spark, base, "call_edges").agg(F.min("config_guard").alias("g"))
    rows = v.edges(spark, base).withColumn("first", first.scalar())
    return rows.groupBy(c.guard_holds("config_guard", enabled).alias("holds"), F.col("config_guard").startswith("!").alias("negated")).agg(F.count(F.lit(1)).alias("n"))


def r_symbol_file(spark: SparkSession, base: str) -> DataFrame:
    sym, file = v.symbols(spark, base), v.files(spark, base).select(F.col("id").alias("file_id"), "path", "sha")
    return sym.join(file, "file_id").groupBy("path").agg(F.count(F.lit(1)).alias("n_symbols"), F.min("name").alias("first_name"))


def r_symbol_left_file(spark: SparkSession, base: str) -> DataFrame:
    file = v.files(spark, base).select(F.col("id").alias("file_id"), "arch")
    return v.symbols(spark, base).join(file, "file_id", "left").groupBy("kind", "arch").agg(F.count(F.lit(1)).alias("n"))


def r_edge_names(spark: SparkSession, base: str) -> DataFrame:
    sym = v.symbols(spark, base)
    caller, callee = sym.select(F.col("id").alias("caller_id"), F.col("name").alias("caller")), sym.select(F.col("id").alias("callee_id"), F.col("name").alias("callee"))
    return v.edges(spark, base).join(caller, "caller_id").join(callee, "callee_id").select("id", "caller", "callee", "line_number")


def r_chunk_content(spark: SparkSession, base: str) -> DataFrame:
    doc = v.content(spark, base).select(F.col("id").alias("content_id"), "status", "content_type")
    joined = v.chunks(spark, base).join(doc, "content_id")
    return joined.groupBy("status", "content_type").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("content_id").alias("n_items"))


def r_module_prefix(spark: SparkSession, base: str) -> DataFrame:
    """Files under the prefixes of a small table; the longest prefix wins."""
    modules = spark.createDataFrame([("drivers/",), ("net/",), ("net/pith/",), ("arch/",)], "module string")
    hit = v.files(spark, base).join(modules, F.col("path").startswith(F.col("module")), "left")
    return hit.groupBy("id").agg(F.max_by("module", F.length("module")).alias("module"))


def r_all_tags(spark: SparkSession, base: str) -> DataFrame:
    """Files that hold symbols of every wanted kind."""
    wanted = ["function", "macro"]
    tagged = v.symbols(spark, base).filter(F.col("kind").isin(wanted)).groupBy("file_id").agg(F.count_distinct("kind").alias("n"))
    return tagged.filter(F.col("n") == len(wanted)).select("file_id")


def r_same_in_other_configs(spark: SparkSession, base: str) -> DataFrame:
    """Paths under several configurations, with their number and the first; the rows of a path aren't paired."""
    per = v.files(spark, base).groupBy("path").agg(F.count_distinct("config").alias("n_configs"), F.min("config").alias("first_config"), F.count_distinct("sha").alias("n_versions"))
    return per.filter("n_configs > 1")


def r_json_holds(spark: SparkSession, base: str) -> DataFrame:
    """The sets of call types of callers as JSON arrays, and whether they hold two of them."""
    sets = v.edges(spark, base).filter("caller_id IS NOT NULL").groupBy("caller_id").agg(F.to_json(F.array_sort(F.collect_set("call_type"))).alias("types"))  # a handful of types
    return sets.select("caller_id", c.json_array_holds("types", "direct", "indirect").alias("both"))


def r_first_call_per_callee(spark: SparkSession, base: str) -> DataFrame:
    """Aggregated before the shuffle, so hot callees cost nothing."""
    order = F.struct(F.coalesce("line_number", F.lit(2**31 - 1)), "id")
    best = v.edges(spark, base).filter("callee_id IS NOT NULL").groupBy("callee_id").agg(F.min_by("id", order).alias("edge_id"))
    return best


def a_caller_statistics(spark: SparkSession, base: str) -> DataFrame:
    return st.call_statistics(v.edges(spark, base), "callee_id", "caller_id")


def a_callee_statistics(spark: SparkSession, base: str) -> DataFrame:
    return st.call_statistics(v.edges(spark, base), "caller_id", "callee_id")


def a_file_distribution(spark: SparkSession, base: str) -> DataFrame:
    """The ten files with most calls."""
    return v.edges(spark, base).groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "file_path").limit(10)


def a_graph_totals(spark: SparkSession, base: str) -> DataFrame:
    t = st.call_graph_totals(v.edges(spark, base), v.symbols(spark, base))
    return t.withColumn("mean_confidence", F.round("mean_confidence", 6))


def a_call_types(spark: SparkSession, base: str) -> DataFrame:
    e = v.edges(spark, base).groupBy("call_type", "confidence").agg(F.count(F.lit(1)).alias("n"))
    share = F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("call_type")), 6)
    return e.withColumn("percent", share)


def a_latency(spark: SparkSession, base: str) -> DataFrame:
    s = st.latency_statistics(v.query_log(spark, base), "2024-01-02 00:00:00", "2024-01-20 00:00:00")
    return s.select("query_type", "n", *(F.round(x, 6).alias(x) for x in ("mean_ms", "p50_ms", "p95_ms", "p99_ms")), "n_users")


def a_nearest_rank(spark: SparkSession, base: str) -> DataFrame:
    return st.nearest_rank(v.query_log(spark, base), "query_type", "latency_ms", 0.95).withColumnRenamed("latency_ms", "p95_ms")


def a_cache_hits(spark: SparkSession, base: str) -> DataFrame:
    """Mean of a JSON field and share of even values per type: feedback columns of the log."""
    k = F.get_json_object("props", "$.k").cast("int")
    return v.query_log(spark, base).groupBy("query_type").agg(F.round(F.avg(k), 6).alias("mean_k"), F.round(F.avg((k % 2 == 0).cast("int")), 6).alias("even_share"))


def a_status(spark: SparkSession, base: str) -> DataFrame:
    r = st.status_report(v.content(spark, base), "status", F.length("content"), "chunk_count", "updated_at")
    return r.withColumn("mean_size", F.round("mean_size", 6)).withColumn("last_update", F.unix_micros("last_update"))


def a_vector_statistics(spark: SparkSession, base: str) -> DataFrame:
    s = st.vector_statistics(v.chunks(spark, base), "embedding", "content_id", "created_at")
    return s.select("n", "n_items", "n_missing", F.round("mean_width", 6).alias("mean_width"), "n_widths", F.col("days").cast("long").alias("days"), F.round("growth_per_day", 6).alias("growth_per_day"))


def a_run_progress(spark: SparkSession, base: str) -> DataFrame:
    ledger = table(spark, base, "content_ledger").distinct()
    p = ledger.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "ok").alias("n_ok"), F.count_if(F.col("outcome") == "error").alias("n_error"))
    runs = table(spark, base, "index_run").select("run_id", "status")
    return runs.join(p, "run_id", "left").select("run_id", "status", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("n", "n_ok", "n_error")), F.round(F.coalesce(100.0 * F.col("n_ok") / F.col("n"), F.lit(0.0)), 2).alias("percent_ok"))


def a_worst_level(spark: SparkSession, base: str) -> DataFrame:
    edges = v.edges(spark, base).filter("conditional").select(F.col("caller_id").alias("id"), "confidence")
    return st.worst_of(edges, v.symbols(spark, base), "id", "confidence", ["low", "medium", "high"], "none").groupBy("worst").agg(F.count(F.lit(1)).alias("n"))


def a_level_map(spark: SparkSession, base: str) -> DataFrame:
    found = st.level_counts(v.edges(spark, base), "call_type", "confidence")
    return found.select("call_type", "n", F.to_json("counts").alias("counts"))


def a_ordered_json(spark: SparkSession, base: str) -> DataFrame:
    """The symbols of each file as a JSON array in line order."""
    sym = v.symbols(spark, base)
    ordered = F.array_sort(F.collect_list(F.struct("start_line", "id", "name")))
    return sym.groupBy("file_id").agg(F.to_json(F.transform(ordered, lambda s: F.struct(s["start_line"].alias("line"), s["name"].alias("name")))).alias("symbols"))


def a_path_confidence(spark: SparkSession, base: str) -> DataFrame:
    """Product, least and greatest confidence of a path of three calls, the first of a file; ``a_path_confidence_all`` takes all."""
    first = Window.partitionBy("file_path").orderBy("id")
    three = v.edges(spark, base).filter("file_path IS NOT NULL").withColumn("rn", F.row_number().over(first)).filter("rn <= 3")
    path = three.groupBy("file_path").agg(F.collect_list("confidence").alias("levels"))
    number = F.transform("levels", lambda x: c.lookup(x, c.CONFIDENCE_LEVEL))
    return path.select("file_path", F.round(c.path_confidence("levels"), 6).alias("product"), F.array_min(number).alias("least"), F.array_max(number).alias("greatest"))


def a_path_confidence_all(spark: SparkSession, base: str) -> DataFrame:
    """The same over all calls of a file; products of many calls are only told apart by their logarithm."""
    calls = v.edges(spark, base).filter("file_path IS NOT NULL")
    number = c.lookup(F.col("confidence"), c.CONFIDENCE_LEVEL)
    weight = F.when(F.col("confidence").isNotNull(), c.lookup(F.col("confidence"), c.CONFIDENCE_PATH, 0.5))
    path = calls.groupBy("file_path").agg(F.count("confidence").alias("n_calls"), F.sum(F.ln(weight)).alias("s"), F.min(number).alias("least"), F.max(number).alias("greatest"))
    return path.select("file_path", "n_calls", F.round(F.coalesce(F.exp("s"), F.lit(0.0)), 6).alias("product"), F.round("s", 6).alias("log_product"), "least", "greatest")


def w_span_merge(spark: SparkSession, base: str) -> DataFrame:
    return st.merge_spans(v.symbols(spark, base), ["file_id"], "start_line", "end_line")


def w_rank(spark: SparkSession, base: str) -> DataFrame:
    per = v.query_log(spark, base).withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy(F.col("latency_ms").desc(), "event_id")))
    return per.filter("rank <= 3").select("user", "rank", "event_id")


def w_sequence(spark: SparkSession, base: str) -> DataFrame:
    """Numbered names per top folder."""
    top = F.split_part("path", F.lit("/"), F.lit(1))
    numbered = v.files(spark, base).withColumn("top", top).withColumn("n", F.row_number().over(Window.partitionBy("top").orderBy("path", "id")))
    return numbered.select("id", F.format_string("%s_%03d", "top", "n").alias("sequence_id"))


def w_latest_run(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "index_run").filter("status = 'completed'").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


def s_page(spark: SparkSession, base: str) -> DataFrame:
    """The third page of ten symbols by name."""
    return st.page(v.symbols(spark, base).select("name", "id"), ["name", "id"], 10, 2)


def o_set_difference(spark: SparkSession, base: str) -> DataFrame:
    """Callers that are never called, and callees that never call."""
    g = v.graph(spark, base)
    a, b = g.select(F.col("src").alias("node")).distinct(), g.select(F.col("dst").alias("node")).distinct()
    side = lambda df, s: df.select("node", F.lit(s).alias("side"))
    return side(a.join(b, "node", "left_anti"), "caller only").unionByName(side(b.join(a, "node", "left_anti"), "callee only"))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__name__", "")[:2] in ("r_", "a_", "w_", "s_", "o_")}

_CALLS = "{key}, count(*) AS n_calls, count(DISTINCT {other}) AS n_others, count(CASE WHEN call_type = 'direct' THEN 1 END) AS n_direct, count(CASE WHEN call_type = 'indirect' THEN 1 END) AS n_indirect, count(CASE WHEN conditional THEN 1 END) AS n_conditional FROM edge WHERE {key} IS NOT NULL GROUP BY {key}"
_NUMBER = "CASE x WHEN 'high' THEN {0} WHEN 'medium' THEN {1} WHEN 'low' THEN {2} ELSE {3} END"

SQL = {
    "r_equality_in": v.with_(v.SYM) + "SELECT id, name FROM sym WHERE kind = 'function' AND config IN ('x86_64:defconfig', 'x86_64:allmod')",
    "r_confidence_at_least": v.with_(v.EDGE) + "SELECT id, confidence FROM edge WHERE CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END >= 2",
    "r_guard_or_none": v.with_(v.EDGE) + "SELECT config_guard, count(*) AS n FROM edge WHERE config_guard IS NULL OR config_guard = (SELECT min(config_guard) FROM call_edges) GROUP BY 1",
    "r_name_search": v.with_(v.SYM) + "SELECT id, name, coalesce(signature, name || ' (' || kind || ')') AS signature, 0.95::DOUBLE AS score FROM sym WHERE name ILIKE '%RING%'",
    "r_path_patterns": v.with_(v.FILE) + r"SELECT id, path FROM file WHERE (path LIKE 'drivers/%' OR path LIKE 'net/%\__.c' ESCAPE '\') AND NOT path LIKE '%\_1%' ESCAPE '\'",
    "r_subsystem_counts": v.with_(v.FILE) + "SELECT CASE WHEN path LIKE 'drivers/%' THEN 'drivers' WHEN path LIKE 'net/%' THEN 'net' WHEN path LIKE 'fs/%' THEN 'fs' ELSE 'other' END AS subsystem, count(*) AS n FROM file GROUP BY 1",
    "r_config_active": v.with_(v.EDGE) + "SELECT coalesce(length(ltrim(config_guard, '!')) % 2 = 0, true) AS active, count(*) AS n FROM edge GROUP BY 1",
    "r_guard_syntax": v.with_(v.EDGE) + "SELECT regexp_matches(config_guard, '^!?CONFIG_[A-Z0-9_]+$') AS valid, coalesce(conditional, false) AS conditional, count(*) AS n FROM edge WHERE config_guard IS NOT NULL GROUP BY 1, 2",
    "r_chunks_without_content": v.with_(v.CHUNK, v.DOC) + "SELECT id, content_id FROM chunk WHERE content_id IS NULL OR content_id NOT IN (SELECT id FROM doc WHERE status = 'COMPLETED')",
    "r_json_holds": v.with_(v.EDGE) + "SELECT caller_id, bool_or(call_type = 'direct') AND bool_or(call_type = 'indirect') AS \"both\" FROM edge WHERE caller_id IS NOT NULL GROUP BY 1",
    "r_chunks_of_failed": v.with_(v.CHUNK, v.DOC) + "SELECT id, content_id FROM chunk WHERE content_id IN (SELECT id FROM doc WHERE status = 'FAILED')",
    "r_metadata_fields": v.with_(v.EDGE) + """
, j AS (SELECT NOT json_valid(metadata) AS broken, CASE WHEN json_valid(metadata) THEN metadata END AS m FROM edge WHERE metadata IS NOT NULL)
SELECT broken, (m->>'$.pass')::INTEGER AS pass, m->>'$.src' AS src, count(*) AS n FROM j GROUP BY 1, 2, 3""",
    "r_guard_holds": v.with_(v.EDGE, "f AS (SELECT regexp_replace(min(config_guard), '^!', '') AS o FROM call_edges)") + """
, e AS (SELECT config_guard AS g, regexp_replace(config_guard, '^!', '') IN ('CONFIG_NET', o) AS is_on FROM edge, f)
SELECT CASE WHEN g IS NULL THEN true WHEN starts_with(g, '!') THEN NOT is_on ELSE is_on END AS holds, starts_with(g, '!') AS negated, count(*) AS n FROM e GROUP BY 1, 2""",
    "r_symbol_file": v.with_(v.SYM, v.FILE) + "SELECT path, count(*) AS n_symbols, min(name) AS first_name FROM sym JOIN file ON file.id = sym.file_id GROUP BY path",
    "r_symbol_left_file": v.with_(v.SYM, v.FILE) + "SELECT kind, arch, count(*) AS n FROM sym LEFT JOIN file ON file.id = sym.file_id GROUP BY 1, 2",
    "r_edge_names": v.with_(v.SYM, v.EDGE) + "SELECT edge.id, a.name AS caller, b.name AS callee, line_number FROM edge JOIN sym a ON a.id = caller_id JOIN sym b ON b.id = callee_id",
    "r_chunk_content": v.with_(v.CHUNK, v.DOC) + "SELECT status, content_type, count(*) AS n_chunks, count(DISTINCT content_id) AS n_items FROM chunk JOIN doc ON doc.id = content_id GROUP BY 1, 2",
    "r_module_prefix": v.with_(v.FILE) + "SELECT file.id, arg_max(module, length(module)) AS module FROM file LEFT JOIN (VALUES ('drivers/'), ('net/'), ('net/pith/'), ('arch/')) m(module) ON starts_with(path, module) GROUP BY file.id",
    "r_all_tags": v.with_(v.SYM) + "SELECT file_id FROM sym WHERE kind IN ('function', 'macro') GROUP BY file_id HAVING count(DISTINCT kind) = 2",
    "r_same_in_other_configs": v.with_(v.FILE) + "SELECT path, count(DISTINCT config) AS n_configs, min(config) AS first_config, count(DISTINCT sha) AS n_versions FROM file GROUP BY 1 HAVING count(DISTINCT config) > 1",
    "r_first_call_per_callee": v.with_(v.EDGE) + "SELECT callee_id, arg_min(id, (coalesce(line_number, 2147483647), id)) AS edge_id FROM edge WHERE callee_id IS NOT NULL GROUP BY callee_id",
    "a_caller_statistics": v.with_(v.EDGE) + "SELECT " + _CALLS.format(key="callee_id", other="caller_id"),
    "a_callee_statistics": v.with_(v.EDGE) + "SELECT " + _CALLS.format(key="caller_id", other="callee_id"),
    "a_file_distribution": v.with_(v.EDGE) + "SELECT file_path, count(*) AS n FROM edge GROUP BY 1 ORDER BY n DESC, file_path LIMIT 10",
    "a_graph_totals": v.with_(v.EDGE, v.SYM) + f"""
SELECT count(*) AS n_calls, count(CASE WHEN call_type = 'direct' THEN 1 END) AS n_direct, count(CASE WHEN call_type = 'indirect' THEN 1 END) AS n_indirect,
  count(CASE WHEN conditional THEN 1 END) AS n_conditional, round(avg({_NUMBER.format(1.0, 0.5, 0.1, 'NULL').replace('CASE x', 'CASE confidence')}::DOUBLE), 6) AS mean_confidence,
  (SELECT count(*) FROM sym WHERE id NOT IN (SELECT caller_id FROM edge WHERE caller_id IS NOT NULL) AND id NOT IN (SELECT callee_id FROM edge WHERE callee_id IS NOT NULL)) AS n_symbols_without_calls
FROM edge""",
    "a_call_types": v.with_(v.EDGE) + "SELECT call_type, confidence, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY call_type), 6) AS percent FROM edge GROUP BY 1, 2",
    "a_latency": v.with_(v.LOG) + """
SELECT query_type, count(*) AS n, round(avg(latency_ms), 6) AS mean_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms, count(DISTINCT "user") AS n_users
FROM log WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1""",
    "a_nearest_rank": v.with_(v.LOG) + "SELECT query_type, count(*) AS n, list_sort(list(latency_ms))[least(floor(0.95 * count(*))::BIGINT + 1, count(*))] AS p95_ms FROM log WHERE latency_ms IS NOT NULL GROUP BY 1",
    "a_cache_hits": v.with_(v.LOG) + "SELECT query_type, round(avg(k), 6) AS mean_k, round(avg(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END), 6) AS even_share FROM (SELECT query_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM log) GROUP BY 1",
    "a_status": v.with_(v.DOC) + "SELECT status, count(*) AS n, coalesce(sum(chunk_count), 0)::BIGINT AS n_parts, coalesce(sum(length(content)), 0)::BIGINT AS total_size, round(coalesce(avg(length(content)), 0), 6) AS mean_size, epoch_us(max(updated_at)) AS last_update FROM doc GROUP BY 1",
    "a_vector_statistics": v.with_(v.CHUNK) + """
, s AS (SELECT count(*) AS n, count(DISTINCT content_id) AS n_items, count(*) - count(embedding) AS n_missing, avg(len(embedding)) AS w, count(DISTINCT len(embedding)) AS n_widths,
  greatest((floor(epoch(max(created_at))) - floor(epoch(min(created_at)))) // 86400, 1)::BIGINT AS days FROM chunk)
SELECT n, n_items, n_missing, round(w, 6) AS mean_width, n_widths, days, round(n / days, 6) AS growth_per_day FROM s""",
    "a_run_progress": """
WITH l AS (SELECT DISTINCT * FROM content_ledger),
p AS (SELECT run_id, count(*) AS n, count(CASE WHEN outcome = 'ok' THEN 1 END) AS n_ok, count(CASE WHEN outcome = 'error' THEN 1 END) AS n_error FROM l GROUP BY 1)
SELECT r.run_id, r.status, coalesce(n, 0) AS n, coalesce(n_ok, 0) AS n_ok, coalesce(n_error, 0) AS n_error, round(coalesce(100.0 * n_ok / n, 0), 2) AS percent_ok FROM index_run r LEFT JOIN p USING (run_id)""",
    "a_worst_level": v.with_(v.EDGE, v.SYM) + """
, w AS (SELECT caller_id AS id, min(CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END) AS r FROM edge WHERE conditional GROUP BY 1)
SELECT CASE r WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'none' END AS worst, count(*) AS n FROM sym LEFT JOIN w USING (id) GROUP BY 1""",
    "a_level_map": v.with_(v.EDGE) + """
, p AS (SELECT call_type, confidence, count(*) AS n FROM edge WHERE confidence IS NOT NULL GROUP BY 1, 2)
SELECT call_type, sum(n)::BIGINT AS n, '{' || string_agg('"' || confidence || '":' || n, ',' ORDER BY confidence) || '}' AS counts FROM p GROUP BY 1""",
    "a_ordered_json": v.with_(v.SYM) + """SELECT file_id, '[' || string_agg('{' || CASE WHEN start_line IS NULL THEN '' ELSE '"line":' || start_line || ',' END || '"name":"' || name || '"}', ',' ORDER BY start_line NULLS FIRST, id) || ']' AS symbols FROM sym GROUP BY 1""",
    "a_path_confidence": v.with_(v.EDGE) + f"""
, t AS (SELECT file_path, confidence AS x FROM edge WHERE file_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY id) <= 3)
SELECT file_path, round(coalesce(product(CASE WHEN x IS NOT NULL THEN {_NUMBER.format(0.9, 0.7, 0.5, 0.5)} END), 0), 6) AS product, min({_NUMBER.format(0.95, 0.8, 0.6, 'NULL')})::DOUBLE AS least, max({_NUMBER.format(0.95, 0.8, 0.6, 'NULL')})::DOUBLE AS greatest FROM t GROUP BY 1""",
    "a_path_confidence_all": v.with_(v.EDGE) + f"""
, t AS (SELECT file_path, confidence AS x FROM edge WHERE file_path IS NOT NULL),
w AS (SELECT file_path, x, CASE WHEN x IS NOT NULL THEN {_NUMBER.format(0.9, 0.7, 0.5, 0.5)} END AS p FROM t)
SELECT file_path, count(x) AS n_calls, round(coalesce(exp(sum(ln(p))), 0), 6) AS product, round(sum(ln(p)), 6) AS log_product, min({_NUMBER.format(0.95, 0.8, 0.6, 'NULL')})::DOUBLE AS least, max({_NUMBER.format(0.95, 0.8, 0.6, 'NULL')})::DOUBLE AS greatest FROM w GROUP BY 1""",
    "w_span_merge": v.with_(v.SYM) + """
, s AS (SELECT file_id, start_line AS a, greatest(start_line, coalesce(end_line, start_line)) AS b FROM sym WHERE start_line IS NOT NULL),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY file_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT file_id, min(a) AS start, max(b) AS "end", count(*) AS n FROM i GROUP BY file_id, island""",
    "w_rank": v.with_(v.LOG) + 'SELECT "user", row_number() OVER (PARTITION BY "user" ORDER BY latency_ms DESC, event_id) AS rank, event_id FROM log QUALIFY rank <= 3',
    "w_sequence": v.with_(v.FILE) + "SELECT id, printf('%s_%03d', split_part(path, '/', 1), row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY path, id)) AS sequence_id FROM file",
    "w_latest_run": "SELECT arg_max(run_id, (started_at, run_id)) AS run_id FROM index_run WHERE status = 'completed'",
    "s_page": v.with_(v.SYM) + "SELECT name, id FROM sym ORDER BY name, id LIMIT 10 OFFSET 20",
    "o_set_difference": v.with_(v.GRAPH) + "SELECT DISTINCT src AS node, 'caller only' AS side FROM g WHERE src NOT IN (SELECT dst FROM g) UNION ALL SELECT DISTINCT dst, 'callee only' FROM g WHERE dst NOT IN (SELECT src FROM g)",
}
