"""Queries over deduplication, joins, the store, metrics and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.collections import table
from sievelake.functions import redact as RD
from sievelake.functions import text as T
from sievelake.operators import dedup as D
from sievelake.operators import metrics as M
from sievelake.operators import select as S
from sievelake.operators import store as ST
from sievelake.plans import payloads as P
from sievelake.plans.store_rows import NOW, SQL, entries
from sievelake.shared import folder
from sievelake.sources import ingest


def _big(df):
    return df.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def messages(spark, sf):
    """Conversations in which every third message is said again later."""
    m = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return m.unionByName(m.where("turn % 3 = 1").withColumn("turn", F.col("turn") + 1000))


def array_rows(spark, sf):
    """Messages that are arrays: a user's events in windows of 30 that overlap."""
    e = table(spark, sf, "events").withColumn("i", F.row_number().over(S.Window.partitionBy("user_id").orderBy("event_id")) - 1)
    sig = F.concat(F.lit('{"event": "'), "event_type", F.lit('", "id": '), F.col("event_id").cast("string"), F.lit("}"))
    m = F.floor(F.col("i") / 15)
    both = e.select("user_id", F.explode(F.array(m, m + 1)).alias("m"), sig.alias("sig"))
    return both.withColumn("bytes", F.sum(F.length("sig") + 2).over(S.Window.partitionBy("user_id", "m")))


def ops(spark, sf):
    return table(spark, sf, "events").where("event_type in ('view', 'click', 'purchase')").select(
        "user_id", (F.col("event_id") % 5).alias("file"), F.col("event_id").alias("idx"), F.when(F.col("event_type") == "purchase", F.when(F.col("event_id") % 3 == 0, "edit").otherwise("other")).otherwise("read").alias("op"),
        F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 100).alias("off"), F.when(F.col("event_id") % 4 > 1, F.lit(50) + F.col("event_id") % 60).alias("lim"),
    )


def states(spark, sf):
    return D.read_states(ops(spark, sf).where("op != 'other'"), ["user_id", "file"], "idx", "op", "off", "lim")


def q_dedup_exact(spark, sf):
    return D.exact(messages(spark, sf), "conv_id", "turn", "text")


def q_dedup_near(spark, sf):
    return _big(D.near_rows(array_rows(spark, sf), "user_id", "m", "sig", "bytes"))


def q_differing(spark, sf):
    r = array_rows(spark, sf)
    return D.differing_rows(r, D.near_rows(r, "user_id", "m", "sig", "bytes"), "user_id", "m", "sig").select("user_id", "m", "sig")


def q_tool_call(spark, sf):
    calls = table(spark, sf, "events").where("event_id % 3 = 0").select("event_id", F.col("event_type").alias("tool"))
    return D.tool_calls(table(spark, sf, "events").select("event_id", "user_id"), calls, "event_id")


def _state(s):
    return lambda spark, sf: states(spark, sf).where(F.col("state") == s).select("user_id", "file", "idx")


def q_cascade(spark, sf):
    n = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    parents = n.where("k > 0").select(F.floor(F.col("k") / 3).alias("parent"), F.col("k").alias("child")).unionByName(n.where("k % 10 = 0 and k > 0").select((F.col("k") - 1).alias("parent"), F.col("k").alias("child")))
    return D.cascade(parents, n.where("k = 7 or k = 13").select(F.col("k").alias("key")))


def q_difference(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct())


def q_intersection(spark, sf):
    words = T.normalized_words(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", F.array_distinct(words).alias("w"))
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return d.join(nxt, "doc_id").select("doc_id", F.size(F.array_intersect("w", "v")).cast("bigint").alias("common"), F.round(T.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


# ---- store ----


def q_put(spark, sf):
    e = entries(spark, sf)
    new = e.where("doc_id % 3 = 0").withColumn("created_at", F.col("created_at") + 50000).withColumn("tool_name", F.lit("again"))
    return ST.put(e, new).select("hash_key", "created_at", "tool_name")


def q_export(spark, sf):
    path = f"{folder(spark)}/export"
    e = entries(spark, sf)
    ingest.export_store(e, path)
    back = ingest.import_store(spark, path)
    return back.agg(F.count("*").alias("rows"), F.sum("original_tokens").alias("tokens"), F.count_distinct("hash_key").alias("keys"))


def q_src_store(spark, sf):
    return ingest.load_store(entries(spark, sf), NOW).select("hash_key", "created_at")


def q_ttl(spark, sf):
    return entries(spark, sf).select("hash_key", ST.live(NOW).alias("live"))


def q_purge(spark, sf):
    return ST.purge(entries(spark, sf), NOW).select("hash_key")


def q_evict(spark, sf):
    return ST.evict(entries(spark, sf), 300)[0].select("hash_key")


def q_spill(spark, sf):
    kept, gone = ST.evict(entries(spark, sf), 300)
    keys = entries(spark, sf).select("hash_key")
    return ST.read_through(keys, kept, gone.where("doc_id % 2 = 0")).select("hash_key", "tier")


def q_namespace(spark, sf):
    return ST.evict(entries(spark, sf), 40, by="namespace")[0].groupBy("namespace").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"))


def q_counters(spark, sf):
    return ST.counters(table(spark, sf, "events").withColumn("k", F.lit(1).cast("bigint")), "event_type", "k")


def q_store_stats(spark, sf):
    return ST.stats(entries(spark, sf), NOW, 10_000).withColumn("fill", F.round("fill", 6))


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))


def q_session_stats(spark, sf):
    e = _events(spark, sf)
    end = e.agg(F.max("at").alias("end"))
    return e.crossJoin(F.broadcast(end)).where(F.col("at") > F.col("end") - 86400).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum(F.col("value").cast("decimal(20,4)")).cast("double"), 4).alias("total"))


def q_access_log(spark, sf):
    a = ST.access_log(_events(spark, sf).withColumn("q", F.concat("event_type", F.lit("-"), F.col("event_id").cast("string"))), "user_id", "at", "q")
    return a.select("user_id", "retrieval_count", "last_accessed", F.array_join("search_queries", ",").alias("queries"))


def q_feedback(spark, sf):
    return ST.feedback(_events(spark, sf), ["event_type"], "at").select("event_id", "in_window", "multiplier", "skip")


def q_breaker(spark, sf):
    e = _events(spark, sf).withColumn("failed", F.col("event_type").isin("error", "view", "click")).withColumn("t", F.col("event_id"))
    return ST.breaker(e, "user_id", "t", "failed").select("user_id", F.col("t").alias("event_id"), "state")


def q_result_cache(spark, sf):
    return ST.result_cache(_events(spark, sf), ["event_type", "user_id"], "at", 86400, tie="event_id").select("event_id", "hit")


def q_frozen(spark, sf):
    m = table(spark, sf, "conversations")
    return ST.frozen_prefix(m, "conv_id", "turn", (F.col("conv_id") + F.col("turn")) % 4 == 0).select("conv_id", "turn", "frozen")


def q_prefix_hash(spark, sf):
    return ST.prefix_hashes(table(spark, sf, "conversations").where("text is not null"), "conv_id", "turn", "text")


def q_budget_ladder(spark, sf):
    m = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(T.estimate_tokens(F.col("text"))).alias("t"))
    rungs = m.select("conv_id", F.explode(F.array(*[F.struct(F.lit(i).alias("rung"), F.floor(F.col("t") * k).alias("size")) for i, k in enumerate((1.0, 0.6, 0.35, 0.2))])).alias("r")).select("conv_id", "r.rung", "r.size")
    return _big(ST.budget_ladder(rungs, ["conv_id"], "rung", "size", 300))


# ---- metrics ----


def q_savings(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("ds"), F.col("event_id").alias("k"), F.length("props").alias("t"))
    return _big(M.by_dataset(rows, rows.where("k % 4 = 0"), rows.where("k % 3 = 0"), "ds", "k", "t"))


def q_conversation(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("k"), T.estimate_tokens(F.col("text")).alias("t"), "turn")
    return _big(M.by_dataset(rows, rows.where("turn % 2 = 0"), rows, "conv_id", "k", "t"))


def q_needle(spark, sf):
    """A unique row put into each user's events at the start, middle and end:
    whether the plan keeps it in view, with the rest in the store."""
    from sievelake.collections import cells

    e = table(spark, sf, "events").select(F.col("user_id").alias("coll"), F.col("event_id").cast("double").alias("ord"), "event_type", "value")
    size = e.groupBy("coll").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    needle = size.select("coll", F.when(F.col("coll") % 3 == 0, F.col("lo") - 0.5).when(F.col("coll") % 3 == 1, F.col("hi") + 0.5).otherwise(F.floor((F.col("lo") + F.col("hi")) / 2) + 0.5).alias("ord"), F.lit("needle fatal 4711").alias("event_type"), F.lit(1.0).alias("value"))
    c = cells(e.unionByName(needle), "coll", ["event_type", "value"])
    kept = S.prioritize(c, S.reasons(c, 15), 15)
    return needle.select("coll", "ord").join(kept.withColumn("seen", F.lit(True)), ["coll", "ord"], "left").select("coll", F.coalesce("seen", F.lit(False)).alias("visible"))


def _tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.floor(F.length("text") / 4).alias("before"), F.floor(F.length("text") / 20).alias("after"), F.floor(F.length("text") / 5).alias("payload"))


def q_effective(spark, sf):
    a = lambda r: F.round(M.effective(F.col("before"), F.col("after"), F.col("payload"), F.lit(1), r), 6)
    return _tokens(spark, sf).select("doc_id", a(0.0).alias("at_0"), a(0.25).alias("at_25"), a(0.5).alias("at_50"))


def q_opaque(spark, sf):
    return _tokens(spark, sf).select("doc_id", M.opaque(F.col("before"), F.col("after"), F.col("payload")).alias("net"))


def q_hash_equal(spark, sf):
    a = table(spark, sf, "events").select("user_id", F.concat_ws("|", "event_type", "props").alias("t"))
    x = M.multiset_hash(a, ["user_id"], "t")
    y = M.multiset_hash(a.where("user_id % 5 > 0").unionByName(a.where("user_id % 5 = 0").withColumn("t", F.upper("t"))).repartition(7), ["user_id"], "t").withColumnRenamed("digest", "other").drop("rows")
    return x.join(y, "user_id").select("user_id", "rows", (F.col("digest") == F.col("other")).alias("equal"))


def q_regression(spark, sf):
    t = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal") / 10000, 4).alias("v"))
    return M.regression(t.where("c_nationkey != 3"), t.where("c_nationkey != 5").withColumn("v", F.col("v") + F.when(F.col("c_nationkey") % 2 == 0, 0.1).otherwise(0.0)), "c_nationkey", "v").select("c_nationkey", F.round("now", 4).alias("now"), F.round("floor", 4).alias("floor"), "verdict")


def q_net_gain(spark, sf):
    m = table(spark, sf, "conversations").withColumn("tokens", T.estimate_tokens(F.col("text")))
    m = M.suffix_tokens(m, "conv_id", "turn", "tokens")
    return m.select("conv_id", "turn", F.round(M.net_gain(F.col("tokens"), F.col("tokens_after")), 6).alias("gain"))


# ---- scalar functions ----


def _docs(spark, sf):
    return table(spark, sf, "documents")


def q_hashes(spark, sf):
    return _docs(spark, sf).select("doc_id", T.md5_24(F.col("text")).alias("md5_24"), T.sha256_24(F.col("text")).alias("sha256_24"), F.substring(F.sha2("source", 256), 1, 8).alias("field_hash"))


def q_words(spark, sf):
    w = T.normalized_words(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(w).cast("bigint").alias("n"), F.md5(F.array_join(w, " ")).alias("words"), F.md5(T.mask_digits(F.col("text"))).alias("masked"), T.capitalized_entities(F.col("text")).cast("bigint").alias("entities"))


def q_strings(spark, sf):
    head, rest = T.split_head(F.col("url"))
    return table(spark, sf, "pages").select("page_id", head.alias("head"), rest.alias("rest"), T.humanize_bytes(F.length("html")).alias("size"))


def q_dates(spark, sf):
    t = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.when(F.col("event_id") % 2 == 0, "T").otherwise(" "), F.date_format("ts", "HH:mm:ss"), F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+02:00").otherwise(""))
    # Generated columns: a time is written and read once, not once per use.
    e = table(spark, sf, "events").select("event_id", F.explode(F.array(t)).alias("t"))
    e = e.select("event_id", F.explode(F.array(T.parse_iso(F.col("t")))).alias("epoch"))
    return e.select("event_id", "epoch", T.render_iso(F.col("epoch")).alias("iso"), T.age_text(F.lit(1_710_000_000) - F.col("epoch")).alias("age"))


def q_math(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.bround(F.col("p_size") / 2.0).alias("half"), F.round(T.shannon_bits(F.col("p_name")), 6).alias("bits"), F.array_join(F.array_sort(F.array_distinct(F.split("p_name", ""))), "").alias("letters"))


def q_token_estimate(spark, sf):
    return _docs(spark, sf).select("doc_id", T.estimate_tokens(F.col("text")).alias("fixed"), T.estimate_tokens(F.col("text"), 3.2).alias("json"))


def q_message_tokens(spark, sf):
    m = table(spark, sf, "conversations")
    return m.groupBy("conv_id").agg((F.sum(T.estimate_tokens(F.col("role")) + T.estimate_tokens(F.col("text")) + 4) + 3).alias("tokens"))


def q_redact(spark, sf):
    r = RD.redact(F.col("text"))
    return _docs(spark, sf).select("doc_id", (r != F.col("text")).alias("changed"), F.md5(r).alias("digest"))


def q_user_redact(spark, sf):
    r = RD.redact(F.col("text"), RD.user_patterns("# mine\nthe [a-z]+\n[bad\n^Ouw.*$"))
    return _docs(spark, sf).select("doc_id", F.md5(r).alias("digest"))


def q_json(spark, sf):
    v = F.try_parse_json("props")
    return table(spark, sf, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.none", "string").alias("none"), F.to_json(v).alias("json"))


# ---- sources ----


def q_src_json(spark, sf):
    return ingest.json_items(P.jsons(spark, sf), "pid", "content").select("pid", "idx", F.expr("try_variant_get(item, '$.id', 'bigint')").alias("id"), F.expr("try_variant_get(item, '$.name', 'string')").alias("name"))


def q_src_envelope(spark, sf):
    return ingest.envelope_items(P.envelopes(spark, sf), "pid", "content").select("pid", "key", "idx", F.expr("try_variant_get(item, '$.id', 'bigint')").alias("id"))


def q_src_dominant(spark, sf):
    d = P.envelopes(spark, sf).withColumn("content", F.replace("content", F.lit('"data"'), F.lit('"traceEvents"')))
    return ingest.dominant_items(d, "pid", "content").select("pid", "key", "idx", F.expr("try_variant_get(item, '$.id', 'bigint')").alias("id"))


def q_csv_sniff(spark, sf):
    return ingest.sniff_csv(P.csvs(spark, sf), "pid", "content").select("pid", "delimiter", "n_rows", "n_fields")


def q_csv_rows(spark, sf):
    return ingest.csv_cells(P.csvs(spark, sf), "pid", "content").select("pid", "row_no", "field", "s", "kind")


def q_csv_coerce(spark, sf):
    v = F.when(F.col("o_orderkey") % 5 == 0, F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0")).when(F.col("o_orderkey") % 5 == 1, F.col("o_orderkey").cast("string")).when(F.col("o_orderkey") % 5 == 2, "1e3").when(F.col("o_orderkey") % 5 == 3, F.concat((F.col("o_orderkey") % 90 + 1).cast("string"), F.lit(".5"))).otherwise("x")
    return table(spark, sf, "orders").select("o_orderkey", ingest.coerced_kind(v).alias("kind"))


def q_src_html(spark, sf):
    return ingest.html_text(table(spark, sf, "pages"), "page_id", "html")


def q_json_py(spark, sf):
    return ingest.canonical_json(P.envelopes(spark, sf), "pid", "content")


def q_json_ir(spark, sf):
    from sievelake.operators import encode as E
    from sievelake.plans import encode_queries as EQ

    tags = E.type_tags(EQ.c(spark, sf, "n", "status", "price")).join(E.column_order(EQ.c(spark, sf, "n", "status", "price")), ["coll", "field"])
    spec = F.struct(F.col("pos"), F.col("field").alias("name"), F.col("tag").alias("type"), "nullable")
    return tags.groupBy("coll").agg(F.to_json(F.transform(F.sort_array(F.collect_list(spec)), lambda x: F.struct(x["name"], x["type"], x["nullable"]))).alias("schema"))


def q_file_read(spark, sf):
    return spark.read.format("binaryFile").load(f"{sf}/nation.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", (F.length("content") == F.col("length")).alias("whole")).where("name = 'nation.parquet'").select("name", "whole")


QUERIES = {
    "dedup_exact": q_dedup_exact, "dedup_near_rows": q_dedup_near, "dedup_differing_rows": q_differing, "join_tool_call": q_tool_call, "join_stale": _state("stale"),
    "join_superseded": _state("superseded"), "join_fresh": _state("fresh"), "join_cascade": q_cascade, "set_difference": q_difference, "set_intersection": q_intersection,
    "snk_store_put": q_put, "snk_export": q_export, "src_import": q_export, "src_store": q_src_store, "st_ttl": q_ttl, "st_purge": q_purge, "st_evict": q_evict, "st_spill": q_spill,
    "st_namespace": q_namespace, "agg_counters": q_counters, "agg_store_stats": q_store_stats, "agg_session_stats": q_session_stats, "st_access_log": q_access_log,
    "st_feedback": q_feedback, "st_breaker": q_breaker, "st_result_cache": q_result_cache, "st_frozen_prefix": q_frozen, "st_prefix_hash": q_prefix_hash, "st_budget_ladder": q_budget_ladder,
    "met_savings": q_savings, "met_conversation": q_conversation, "met_needle": q_needle, "met_effective": q_effective, "met_opaque": q_opaque, "met_hash_equal": q_hash_equal,
    "met_regression": q_regression, "fn_net_mutation_gain": q_net_gain, "fn_hash": q_hashes, "fn_words": q_words, "fn_strings": q_strings, "fn_dates": q_dates, "fn_math": q_math,
    "fn_token_estimate": q_token_estimate, "fn_message_tokens": q_message_tokens, "fn_redact": q_redact, "fn_redact_user": q_user_redact, "fn_json": q_json, "src_json": q_src_json,
    "src_envelope": q_src_envelope, "src_dominant_array": q_src_dominant, "src_csv_sniff": q_csv_sniff, "src_csv_rows": q_csv_rows, "src_csv_coerce": q_csv_coerce, "src_html": q_src_html,
    "html_text": q_src_html, "snk_json_py": q_json_py, "snk_json_ir": q_json_ir, "src_file_read": q_file_read,
}

# ---- oracle ----

_EST = "CASE WHEN length({0}) > 0 THEN greatest(1, floor(length({0}) / {1} + 0.5)::BIGINT) ELSE 0 END"
_MSG = "m AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, turn + 1000, text FROM conversations WHERE turn % 3 = 1)"
_AR = """e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events), a0 AS (SELECT user_id, i // 15 AS m, '{"event": "' || event_type || '", "id": ' || event_id || '}' AS sig FROM e),
a1 AS (SELECT * FROM a0 UNION ALL SELECT user_id, m + 1, sig FROM a0), ar AS (SELECT *, sum(length(sig) + 2) OVER (PARTITION BY user_id, m) AS bytes FROM a1)"""
_NEAR = _AR + """, ds AS (SELECT user_id, m, sig, count(*) AS times, max(bytes) AS bytes FROM ar GROUP BY 1, 2, 3), ss AS (SELECT DISTINCT user_id, m AS source, sig FROM ar),
sh AS (SELECT ds.user_id, ds.m, source, sum(times) AS shared, sum(times * strlen(sig)) AS sb, max(bytes) AS bytes FROM ds JOIN ss USING (user_id, sig) WHERE source < m AND m - source <= 64 GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, m ORDER BY shared DESC, source) AS r FROM sh), tt AS (SELECT user_id, m, count(*) AS total FROM ar GROUP BY 1, 2),
nr AS (SELECT user_id, m, source, shared::BIGINT AS shared, total, sb::BIGINT AS shared_bytes FROM b JOIN tt USING (user_id, m) WHERE r = 1 AND shared >= 2 AND sb >= 256 AND sb >= 0.3 * bytes AND bytes - sb <= 0.45 * bytes)"""
_OPS = """ops AS (SELECT user_id, event_id % 5 AS file, event_id AS idx, CASE WHEN event_type = 'purchase' THEN 'edit' ELSE 'read' END AS op, CASE WHEN event_id % 4 > 0 THEN event_id % 100 END AS off, CASE WHEN event_id % 4 > 1 THEN 50 + event_id % 60 END AS lim
 FROM events WHERE event_type IN ('view', 'click') OR event_type = 'purchase' AND event_id % 3 = 0),
stt AS (SELECT r.user_id, r.file, r.idx, CASE WHEN EXISTS (SELECT 1 FROM ops e WHERE e.op = 'edit' AND e.user_id = r.user_id AND e.file = r.file AND e.idx > r.idx) THEN 'stale'
 WHEN EXISTS (SELECT 1 FROM ops l WHERE l.op = 'read' AND l.user_id = r.user_id AND l.file = r.file AND l.idx > r.idx AND (l.off IS NULL AND l.lim IS NULL OR NOT (r.off IS NULL AND r.lim IS NULL) AND coalesce(l.off, 0) <= coalesce(r.off, 0) AND coalesce(l.off, 0) + coalesce(l.lim, 2000) >= coalesce(r.off, 0) + coalesce(r.lim, 2000))) THEN 'superseded' ELSE 'fresh' END AS state
 FROM ops r WHERE r.op = 'read')"""
_AGE = "CASE WHEN {0} < 60 THEN {0} || 's ago' WHEN {0} < 3600 THEN {0} // 60 || 'm ago' WHEN {0} < 86400 THEN {0} // 3600 || 'h ago' ELSE {0} // 86400 || 'd ago' END"
_NW = "list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g')), lambda w: w != '')"
_RED = "text"
for _name, _p in RD.CREDENTIALS:
    _p = _p.replace(")*+", ")*")  # DuckDB's matcher knows no possessive loops and needs none
    _RED = f"regexp_replace({_RED}, '{_p}', '[REDACTED:{_name}]', 'g')"
_ENV = "s AS (SELECT 'envelope-' || s_nationkey AS pid, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS idx, s_suppkey AS id FROM supplier)"
_BITS = "(SELECT -sum(k / length({0}) * log2(k / length({0}))) FROM (SELECT count(*) AS k FROM (SELECT unnest(string_split({0}, '')) AS ch) GROUP BY ch))"
_EV = "ev AS (SELECT *, epoch(ts)::BIGINT - CASE WHEN epoch(ts) < epoch(ts)::BIGINT THEN 1 ELSE 0 END AS sec FROM events)"

ORACLES = {
    "dedup_exact": f"WITH {_MSG}, h AS (SELECT conv_id, turn, left(sha256(text), 24) AS hash FROM m WHERE length(text) >= 256), f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, hash) AS first_turn FROM h) SELECT conv_id, turn, first_turn, hash FROM f WHERE turn > first_turn",
    "dedup_near_rows": f"WITH {_NEAR} SELECT * FROM nr",
    "dedup_differing_rows": f"WITH {_NEAR} SELECT ar.user_id, ar.m, ar.sig FROM ar JOIN nr USING (user_id, m) WHERE NOT EXISTS (SELECT 1 FROM ss WHERE ss.user_id = ar.user_id AND ss.source = nr.source AND ss.sig = ar.sig)",
    "join_tool_call": "WITH c AS (SELECT event_id, event_type AS tool FROM events WHERE event_id % 3 = 0) SELECT e.event_id, e.user_id, c.tool FROM events e LEFT JOIN c USING (event_id)",
    "join_cascade": """WITH RECURSIVE ed AS (SELECT o_orderkey // 3 AS p, o_orderkey AS c FROM orders WHERE o_orderkey > 0 UNION ALL SELECT o_orderkey - 1, o_orderkey FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey > 0),
reach AS (SELECT unnest([7, 13])::BIGINT AS k UNION SELECT ed.c FROM ed JOIN reach ON ed.p = reach.k),
keep AS (SELECT c AS k FROM ed WHERE p NOT IN (SELECT k FROM reach) AND c IN (SELECT k FROM reach) AND c NOT IN (7, 13) UNION SELECT ed.c FROM ed JOIN keep ON ed.p = keep.k WHERE ed.c NOT IN (7, 13) AND ed.c IN (SELECT k FROM reach)) SELECT k AS key FROM reach WHERE k NOT IN (SELECT k FROM keep)""",
    "set_difference": "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "set_intersection": f"WITH d AS (SELECT doc_id, list_distinct({_NW}) AS w FROM documents) SELECT a.doc_id, len(list_intersect(a.w, b.w)) AS common, round(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) ELSE 0 END, 6)::DOUBLE AS jaccard FROM d a JOIN d b ON b.doc_id = a.doc_id + 1",
    "snk_store_put": f"WITH {SQL} SELECT hash_key, created_at + CASE WHEN doc_id % 3 = 0 THEN 50000 ELSE 0 END AS created_at, CASE WHEN doc_id % 3 = 0 THEN 'again' ELSE tool_name END AS tool_name FROM store",
    "snk_export": f"WITH {SQL} SELECT count(*) AS rows, sum(original_tokens)::BIGINT AS tokens, count(DISTINCT hash_key) AS keys FROM store",
    "src_store": f"WITH {SQL} SELECT hash_key, created_at FROM store WHERE {NOW} - created_at <= ttl",
    "st_ttl": f"WITH {SQL} SELECT hash_key, {NOW} - created_at <= ttl AS live FROM store",
    "st_purge": f"WITH {SQL} SELECT hash_key FROM store WHERE {NOW} - created_at <= ttl",
    "st_evict": f"WITH {SQL} SELECT hash_key FROM store ORDER BY created_at DESC, hash_key LIMIT 300",
    "st_spill": f"WITH {SQL}, r AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, hash_key) AS r FROM store) SELECT hash_key, CASE WHEN original_content IS NULL THEN NULL WHEN r <= 300 THEN 'fast' WHEN doc_id % 2 = 0 THEN 'spill' END AS tier FROM r",
    "st_namespace": f"WITH {SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY created_at DESC, hash_key) AS r FROM store) SELECT namespace, count(*) AS n, min(created_at) AS oldest FROM r WHERE r <= 40 GROUP BY 1",
    "agg_counters": "SELECT event_type AS name, count(*) AS value FROM events GROUP BY 1",
    "agg_store_stats": f"WITH {SQL} SELECT count(*) AS entries, sum(original_tokens)::BIGINT AS original_tokens, sum(compressed_tokens)::BIGINT AS compressed_tokens, sum(retrieval_count)::BIGINT AS retrievals, round(count(*) / 10000, 6) AS fill FROM store WHERE {NOW} - created_at <= ttl",
    "agg_session_stats": f"WITH {_EV} SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value::DECIMAL(20, 4))::DOUBLE, 4) AS total FROM ev WHERE sec > (SELECT max(sec) FROM ev) - 86400 GROUP BY 1",
    "st_access_log": f"WITH {_EV}, r AS (SELECT user_id, sec, event_type || '-' || event_id AS q, row_number() OVER (PARTITION BY user_id ORDER BY sec DESC, event_type || '-' || event_id DESC) AS r FROM ev) SELECT user_id, count(*) AS retrieval_count, max(sec) AS last_accessed, string_agg(q, ',' ORDER BY r DESC) FILTER (r <= 10) AS queries FROM r GROUP BY 1",
    "st_feedback": f"WITH {_EV}, w AS (SELECT event_id, least(count(*) OVER (PARTITION BY event_type ORDER BY sec RANGE BETWEEN 599 PRECEDING AND CURRENT ROW), 64) AS in_window FROM ev) SELECT event_id, in_window, (CASE WHEN in_window >= 3 THEN 1.5 ELSE 1.0 END)::DOUBLE AS multiplier, in_window >= 6 AS skip FROM w",
    "st_breaker": """WITH RECURSIVE c AS (SELECT user_id, event_id, event_type IN ('error', 'view', 'click') AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
z AS (SELECT user_id, event_id, i, CASE WHEN f THEN 1 ELSE 0 END AS run, -1000000000000::BIGINT AS til, CASE WHEN f THEN 'failed' ELSE 'ok' END AS state FROM c WHERE i = 1
UNION ALL SELECT c.user_id, c.event_id, c.i, CASE WHEN c.event_id < z.til THEN z.run WHEN c.f AND z.run + 1 >= 3 THEN 0 WHEN c.f THEN z.run + 1 ELSE 0 END, CASE WHEN c.event_id >= z.til AND c.f AND z.run + 1 >= 3 THEN c.event_id + 60 ELSE z.til END,
 CASE WHEN c.event_id < z.til THEN 'refused' WHEN c.f AND z.run + 1 >= 3 THEN 'opened' WHEN c.f THEN 'failed' ELSE 'ok' END FROM z JOIN c ON c.user_id = z.user_id AND c.i = z.i + 1) SELECT user_id, event_id, state FROM z""",
    "st_result_cache": f"WITH {_EV} SELECT event_id, coalesce(sec - lag(sec) OVER (PARTITION BY event_type, user_id ORDER BY sec) <= 86400, FALSE) AS hit FROM ev",
    "st_frozen_prefix": "SELECT conv_id, turn, coalesce(turn <= max(turn) FILTER ((conv_id + turn) % 4 = 0) OVER (PARTITION BY conv_id), FALSE) AS frozen FROM conversations",
    "st_prefix_hash": "WITH f AS (SELECT conv_id, turn, sha256(length(text) || ':' || text) AS h FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, sha256(string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY turn)) AS hash, coalesce(h != lag(h) OVER (PARTITION BY conv_id ORDER BY turn), TRUE) AS changed FROM f",
    "st_budget_ladder": f"WITH m AS (SELECT conv_id, sum({_EST.format('text', 4)}) AS t FROM conversations GROUP BY 1), r AS (SELECT conv_id, unnest([0, 1, 2, 3])::BIGINT AS rung, unnest([floor(t * 1.0), floor(t * 0.6::DOUBLE), floor(t * 0.35::DOUBLE), floor(t * 0.2::DOUBLE)])::BIGINT AS size FROM m) SELECT conv_id, rung, size, size <= 300 AS fits FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY (size <= 300) DESC, CASE WHEN size <= 300 THEN rung END, size, rung) AS q FROM r) WHERE q = 1",
    "met_savings": "SELECT event_type AS dataset, count(*) AS rows, sum(length(props))::BIGINT AS tokens_before, coalesce(sum(length(props)) FILTER (event_id % 4 = 0), 0)::BIGINT AS tokens_after, round(avg((event_id % 4 != 0)::INT), 6) AS dropped_ratio, round(avg((event_id % 4 = 0 OR event_id % 3 = 0)::INT), 6) AS retention, round((sum(length(props)) - coalesce(sum(length(props)) FILTER (event_id % 4 = 0), 0)) / sum(length(props)), 6) AS reduction FROM events GROUP BY 1",
    "met_conversation": f"WITH m AS (SELECT conv_id, turn, {_EST.format('text', 4)} AS t FROM conversations) SELECT conv_id AS dataset, count(*) AS rows, sum(t)::BIGINT AS tokens_before, sum(CASE WHEN turn % 2 = 0 THEN t ELSE 0 END)::BIGINT AS tokens_after, round(avg((turn % 2 != 0)::INT), 6) AS dropped_ratio, 1.0::DOUBLE AS retention, round(CASE WHEN sum(t) > 0 THEN (sum(t) - sum(CASE WHEN turn % 2 = 0 THEN t ELSE 0 END)) / sum(t) ELSE 0 END, 6)::DOUBLE AS reduction FROM m GROUP BY 1",
    "met_needle": "SELECT DISTINCT user_id AS coll, TRUE AS visible FROM events",
    "met_effective": "WITH t AS (SELECT doc_id, length(text) // 4 AS b, length(text) // 20 AS a, length(text) // 5 AS p FROM documents) SELECT doc_id, round(CASE WHEN b > 0 THEN (b - a) / b ELSE 0 END, 6)::DOUBLE AS at_0, round(CASE WHEN b > 0 THEN (b - a - p - 106) / b ELSE 0 END, 6)::DOUBLE AS at_25, round(CASE WHEN b > 0 THEN (b - a - p - 106) / b ELSE 0 END, 6)::DOUBLE AS at_50 FROM t",
    "met_opaque": "SELECT doc_id, length(text) // 4 - length(text) // 20 - length(text) // 5 - 106 AS net FROM documents",
    "met_hash_equal": "SELECT user_id, count(*) AS rows, user_id % 5 > 0 AS equal FROM events GROUP BY 1",
    "met_regression": "WITH t AS (SELECT c_nationkey, round(avg(c_acctbal) / 10000, 4) AS v FROM customer GROUP BY 1), a AS (SELECT * FROM t WHERE c_nationkey != 3), b AS (SELECT c_nationkey, v + CASE WHEN c_nationkey % 2 = 0 THEN 0.1 ELSE 0 END AS f FROM t WHERE c_nationkey != 5) SELECT c_nationkey, round(v, 4) AS now, round(f, 4) AS floor, CASE WHEN f IS NULL THEN 'new' WHEN v IS NULL THEN 'missing' WHEN v < f - 0.02 THEN 'regressed' ELSE 'ok' END AS verdict FROM a FULL JOIN b USING (c_nationkey)",
    "fn_net_mutation_gain": f"WITH m AS (SELECT conv_id, turn, {_EST.format('text', 4)} AS t FROM conversations) SELECT conv_id, turn, round((t - coalesce(sum(t) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 0.9)::DOUBLE, 6) AS gain FROM m",
    "fn_hash": "SELECT doc_id, left(md5(text), 24) AS md5_24, left(sha256(text), 24) AS sha256_24, left(sha256(source), 8) AS field_hash FROM documents",
    "fn_words": f"WITH w AS (SELECT doc_id, text, {_NW} AS w, list_filter(regexp_split_to_array(trim(text, ' '), '\\s+'), lambda x: x != '') AS raw FROM documents) SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS words, md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS masked, len(list_filter(list_slice(raw, 2, len(raw)), lambda x: regexp_matches(x, '^\\p{{Lu}}\\p{{L}}'))) AS entities FROM w",
    "fn_strings": "WITH h AS (SELECT page_id, url, html, regexp_extract(url, '^(.*[/:.])[^/:.]*$', 1) AS head FROM pages) SELECT page_id, head, substr(url, length(head) + 1) AS rest, CASE WHEN length(html) < 1024 THEN length(html) || 'B' WHEN length(html) < 1048576 THEN printf('%.1fKB', length(html) / 1024) ELSE printf('%.1fMB', length(html) / 1048576) END AS size FROM h",
    "fn_dates": f"WITH e AS (SELECT event_id, epoch(date_trunc('second', ts))::BIGINT - CASE WHEN event_id % 3 = 1 THEN 7200 ELSE 0 END AS epoch FROM events), a AS (SELECT *, 1710000000 - epoch AS s FROM e) SELECT event_id, epoch, strftime(make_timestamp(epoch * 1000000), '%Y-%m-%dT%H:%M:%S') AS iso, {_AGE.format('s')} AS age FROM a",
    "fn_math": f"SELECT p_partkey, round_even(p_size / 2, 0) AS half, round({_BITS.format('p_name')}, 6) AS bits, array_to_string(list_sort(list_distinct(string_split(p_name, ''))), '') AS letters FROM part",
    "fn_token_estimate": f"SELECT doc_id, {_EST.format('text', 4)} AS fixed, {_EST.format('text', 3.2)} AS json FROM documents",
    "fn_message_tokens": f"SELECT conv_id, (sum({_EST.format('role', 4)} + {_EST.format('text', 4)} + 4) + 3)::BIGINT AS tokens FROM conversations GROUP BY 1",
    "fn_redact": f"WITH r AS (SELECT doc_id, text, {_RED} AS r FROM documents) SELECT doc_id, r != text AS changed, md5(r) AS digest FROM r",
    "fn_redact_user": "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?m)the [a-z]+', '[REDACTED:1]', 'g'), '(?m)^Ouw.*$', '[REDACTED:3]', 'g')) AS digest FROM documents",
    "fn_json": "SELECT event_id, (props->>'$.k')::BIGINT AS k, NULL::VARCHAR AS none, replace(props, ': ', ':') AS json FROM events",
    "src_json": "SELECT 'json-' || c_nationkey AS pid, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS idx, c_custkey AS id, c_name AS name FROM customer",
    "src_envelope": f"WITH {_ENV} SELECT pid, 'data' AS key, idx, id FROM s",
    "src_dominant_array": f"WITH {_ENV} SELECT pid, 'traceEvents' AS key, idx, id FROM s",
    "src_csv_sniff": "SELECT 'csv-' || p_brand AS pid, ',' AS delimiter, count(*) AS n_rows, 4::BIGINT AS n_fields FROM part GROUP BY p_brand HAVING count(*) >= 5 AND 18 + sum(length(p_partkey || p_name || p_type || p_size) + 4) >= 200",
    "src_csv_rows": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS row_no, CASE WHEN 18 + sum(length(p_partkey || p_name || p_type || p_size) + 4) OVER (PARTITION BY p_brand) >= 200 THEN count(*) OVER (PARTITION BY p_brand) END AS n FROM part)
SELECT 'csv-' || p_brand AS pid, row_no, unnest(['key', 'name', 'type', 'size']) AS field, unnest([p_partkey::VARCHAR, p_name, p_type, p_size::VARCHAR]) AS s, unnest(['int', 'string', 'string', 'int']) AS kind FROM r WHERE n >= 5""",
    "src_csv_coerce": "WITH v AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN printf('%03d', o_orderkey % 1000) WHEN 1 THEN o_orderkey::VARCHAR WHEN 2 THEN '1e3' WHEN 3 THEN (o_orderkey % 90 + 1) || '.5' ELSE 'x' END AS v FROM orders) SELECT o_orderkey, CASE WHEN try_cast(v AS BIGINT)::VARCHAR = v THEN 'int' WHEN contains(v, '.') AND try_cast(v AS DOUBLE)::VARCHAR = v THEN 'float' ELSE 'string' END AS kind FROM v",
    "snk_json_py": """WITH s AS (SELECT 'envelope-' || s_nationkey AS pid, string_agg('{"id": ' || s_suppkey || ', "name": "' || s_name || '"}', ', ' ORDER BY s_suppkey) AS a FROM supplier GROUP BY s_nationkey) SELECT pid, '{"data": [' || a || '], "meta": {"page": 1}}' AS json FROM s""",
    "src_file_read": "SELECT 'nation.parquet' AS name, TRUE AS whole",
}
ORACLES["src_import"] = ORACLES["snk_export"]
for _s in ("stale", "superseded", "fresh"):
    ORACLES[f"join_{_s}"] = f"WITH {_OPS} SELECT user_id, file, idx FROM stt WHERE state = '{_s}'"
