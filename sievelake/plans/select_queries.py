"""Queries over row selection and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.collections import table
from sievelake.functions import text as T
from sievelake.operators import profile as P
from sievelake.operators import reduce as R
from sievelake.operators import select as S
from sievelake.plans import payloads
from sievelake.plans import profile_queries as Q

FIELDS = ("event_type", "value", "detail")
QUERY = "timeout after 4711 by 'error' in events.example.com"


def c(spark, sf, *fields):
    names = fields or FIELDS
    return Q.event_cells(spark, sf).where(F.col("field").isin(*names))


def _r(col):
    return F.round(col, 6)


def q_dedup(spark, sf):
    return S.dedup_content(S.content_hashes(c(spark, sf, "event_type", "flag")))


def q_novelty(spark, sf):
    return S.families(S.content_hashes(c(spark, sf, "event_type", "props"))).select("coll", "ord", "size", "novelty")


def q_dup_counts(spark, sf):
    return S.dup_counts(c(spark, sf, "event_type", "flag", "number", "props"), ("number", "props"))


def q_singletons(spark, sf):
    return S.singletons(c(spark, sf, "props", "event_type", "number"), ("number",))


def q_minority(spark, sf):
    cells = c(spark, sf, "props", "event_type")
    return S.minority(S.singletons(cells), cells)


def q_density(spark, sf):
    return S.density(c(spark, sf)).select("coll", "ord", _r("density").alias("density"))


def q_anchors(spark, sf):
    return S.anchors(c(spark, sf, "event_type"), 24, "logs", "latest errors")


def q_cluster(spark, sf):
    return S.cluster(c(spark, sf, "props"), "props")


def q_top_n(spark, sf):
    return S.top_n(c(spark, sf, "value"), "value", 15)


def q_time_series(spark, sf):
    return S.around_changes(c(spark, sf, "value"), 2, sigmas=0.8)


def q_query_anchors(spark, sf):
    return spark.createDataFrame([(a,) for a in S.query_anchors(QUERY)], "anchor string")


def q_anchor_rows(spark, sf):
    return S.anchor_matches(c(spark, sf, "event_type", "detail"), QUERY)


def q_relevance(spark, sf):
    return S.query_relevance(c(spark, sf, "event_type", "detail"), "timeout purchase").select("coll", "ord", _r("score").alias("score"), "pinned")


def q_preserve(spark, sf):
    import hashlib

    h = hashlib.sha256(b"event_type").hexdigest()[:8]
    return S.preserve_fields(c(spark, sf), (h,), "show error rows")


def q_stride(spark, sf):
    cells = c(spark, sf, "event_type", "props")
    keep = S.positions(cells).where("pos < 2")
    return S.stride_fill(keep, S.content_hashes(cells), 8)


def q_smart_sample(spark, sf):
    return S.reasons(c(spark, sf), 15).select("coll", "ord", F.array_join("reasons", ",").alias("reasons"))


def q_prioritize(spark, sf):
    cells = c(spark, sf)
    return S.prioritize(cells, S.reasons(cells, 15), 15)


def _lines(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("coll"), F.col("event_id").alias("ord"), F.concat_ws(" ", "event_type", "props").alias("t"))


def q_bigram(spark, sf):
    return S.bigram_curve(_lines(spark, sf), "coll", "ord", "t")


def q_knee(spark, sf):
    return S.knee(S.bigram_curve(_lines(spark, sf), "coll", "ord", "t"))


def q_k_split(spark, sf):
    k = F.col("o_orderkey") % 40
    return table(spark, sf, "orders").select("o_orderkey", S.k_split(k).alias("k")).select("o_orderkey", "k.first", "k.last", "k.rest")


def q_keep_budget(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.keep_budget(F.col("o_orderkey") % 40).cast("bigint").alias("budget"))


def q_offload_gate(spark, sf):
    return payloads.payloads(spark, sf).select("pid", S.offload_gate(F.col("content"), F.when(F.col("kind") == "log", 0.5).otherwise(0.95)).alias("offload"))


def q_offload(spark, sf):
    p = payloads.payloads(spark, sf).where(S.offload_gate(F.col("content"), F.lit(1.0))).select("pid", T.sha256_24(F.col("content")).alias("hash_key"), "content")
    kept = p.select("hash_key", F.col("content").alias("original")).dropDuplicates(["hash_key"])
    view = p.join(kept, "hash_key").where("content = original")  # published only after the stored original is read back
    return view.select("pid", "hash_key", S.offload_preview(F.col("content")).alias("v")).select("pid", "hash_key", F.array_join("v.head", "\n").alias("head"), F.array_join("v.errors", "\n").alias("errors"), F.array_join("v.tail", "\n").alias("tail"), F.col("v.n_lines").cast("bigint").alias("n_lines"))


def q_route(spark, sf):
    a, b = F.col("o_orderkey") % 7, F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderkey") % 5)
    return table(spark, sf, "orders").select("o_orderkey", S.min_tokens_route(a, b).alias("route"))


def q_hamming(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", T.hamming(F.col("l_orderkey"), F.col("l_partkey")).alias("distance"))


def _arrays(spark, sf):
    """JSON arrays of every kind, one per user."""
    e = table(spark, sf, "events")
    k = F.col("user_id") % 4
    item = F.when(k == 0, F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "type": "'), "event_type", F.lit('"}'))).when(k == 1, F.concat(F.lit('"'), "event_type", F.lit(" "), (F.col("event_id") % 9).cast("string"), F.lit('"'))).when(k == 2, F.col("value").cast("string")).otherwise(F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"'))))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", item.alias("t")))), lambda x: x["t"]), ", ")
    return e.groupBy("user_id").agg(F.concat(F.lit("["), body, F.lit("]")).alias("doc"))


def _walked(how=None):
    def q(spark, sf):
        d = R.reduce_documents(_arrays(spark, sf), "user_id", "doc")
        return (d.where(F.col("how") == how) if how else d).select("user_id", "view", "how", F.map_keys("dropped").alias("hashes"))

    return q


def _positions(kind, function):
    def q(spark, sf):
        import json

        return R.per_document(_arrays(spark, sf).where(f"user_id % 4 = {kind}"), "user_id", "doc", lambda t: (function(json.loads(t)),), "kept array<bigint>")

    return q


def q_object_keys(spark, sf):
    import json

    e = table(spark, sf, "events").groupBy("user_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("k"), F.col("event_id").cast("string")), F.concat("event_type", F.lit(" of some length "), "props")))))).alias("doc"))
    return R.per_document(e, "user_id", "doc", lambda t: (R.keep_object_keys(json.loads(t)),), "keys array<string>")


def q_simhash(spark, sf):
    return R.per_document(table(spark, sf, "documents"), "doc_id", "text", lambda t: (None if t is None else R.simhash(t) - (1 << 63),), "simhash bigint")


def q_adaptive(spark, sf):
    return R.per_document(table(spark, sf, "documents"), "doc_id", "text", lambda t: (R.adaptive_k((t or "").split("\n")),), "k int")


def q_zlib(spark, sf):
    return R.per_document(table(spark, sf, "documents"), "doc_id", "text", lambda t: (R.zlib_check((t or "").split("\n"), 3, 50),), "k int")


QUERIES = {
    "sel_dedup_content": q_dedup, "sel_novelty": q_novelty, "sel_dup_counts": q_dup_counts, "sel_singletons": q_singletons, "sel_minority": q_minority, "sel_density": q_density,
    "sel_anchors": q_anchors, "sel_cluster": q_cluster, "sel_top_n": q_top_n, "sel_time_series": q_time_series, "sel_query_anchors": q_query_anchors, "sel_anchor_rows": q_anchor_rows,
    "sel_query_relevance": q_relevance, "sel_preserve_fields": q_preserve, "sel_stride_fill": q_stride, "sel_smart_sample": q_smart_sample, "set_union_reasons": q_smart_sample,
    "sel_prioritize": q_prioritize, "sel_bigram_curve": q_bigram, "sel_knee": q_knee, "sel_k_split": q_k_split, "sel_keep_budget": q_keep_budget, "sel_offload_gate": q_offload_gate,
    "sel_offload": q_offload, "sel_min_tokens_route": q_route, "sel_hamming": q_hamming, "sel_crush_array": _walked(), "sel_walk": _walked(), "sel_lossy": _walked("lossy"),
    "sel_small_array": _walked("lossless"), "sel_strings": _positions(1, R.keep_strings), "sel_numbers": _positions(2, R.keep_numbers), "sel_mixed": _positions(3, R.keep_mixed),
    "sel_records": _positions(0, R.keep_records), "sel_object_keys": q_object_keys, "sel_simhash": q_simhash, "sel_adaptive_k": q_adaptive, "sel_zlib_check": q_zlib,
}


def _w(*fields: str) -> str:
    return Q._with(list(fields or FIELDS))


_TXT = ", rt AS (SELECT coll, ord, string_agg(field || '=' || coalesce(s, 'null'), chr(10) ORDER BY field) AS text FROM {0} GROUP BY 1, 2)"
_HASH = _TXT.format("c") + ", hs AS (SELECT coll, ord, left(md5(text), 16) AS h FROM rt)"
_POS = ", ps AS (SELECT coll, ord, row_number() OVER (PARTITION BY coll ORDER BY ord) - 1 AS pos, count(*) OVER (PARTITION BY coll) AS n FROM (SELECT DISTINCT coll, ord FROM c))"
_ONCE = ", si AS (SELECT DISTINCT coll, ord FROM (SELECT coll, min(ord) AS ord FROM c WHERE s IS NOT NULL AND field != 'number' GROUP BY coll, field, s HAVING count(*) = 1))"
_PAIRS = """WITH l AS (SELECT user_id AS coll, event_id AS ord, list_filter(string_split(lower(event_type || ' ' || props), ' '), lambda x: x != '') AS w FROM events),
p AS (SELECT coll, ord, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM l), f AS (SELECT coll, pair, min(ord) AS ord FROM p GROUP BY 1, 2), k AS (SELECT coll, ord, count(*) AS new FROM f GROUP BY 1, 2),
cv AS (SELECT l.coll, l.ord, CAST(sum(coalesce(new, 0)) OVER (PARTITION BY l.coll ORDER BY l.ord) AS BIGINT) AS seen FROM l LEFT JOIN k USING (coll, ord))"""


def _anchor_sql(budget: int, pattern: str, query: str, src: str = "c") -> str:
    slots = min(12, max(3, int(budget * 0.25)))
    wf, _, wb = S.anchor_weights(pattern, query)
    f, b = max(1, int(slots * wf)), max(1, int(slots * wb))
    m = max(0, slots - f - b)
    zones = [("front", "0", f"least({2 * f}, n // 3)", f), ("back", f"greatest(n - {2 * b}, 2 * n // 3)", "n", b)] + ([("middle", str(f), f"n - {b}", m)] if m else [])
    parts = " UNION ALL ".join(
        f"SELECT coll, unnest(CASE WHEN {hi} - {lo} <= 0 THEN [] WHEN {k} >= {hi} - {lo} THEN range({lo}, {hi}) ELSE list_transform(range(1, {k + 1}), lambda i: least({lo} + floor(i * (({hi} - {lo}) / {float(k + 1)}))::BIGINT, {hi} - 1)) END) AS pos, '{name}' AS region FROM szz WHERE n > {budget}"
        for name, lo, hi, k in zones
    )
    return f", szz AS (SELECT DISTINCT coll, n FROM ps), wz AS ({parts}), anc AS (SELECT ps.coll, ps.ord, min(region) AS region FROM ps JOIN wz USING (coll, pos) WHERE n > {budget} GROUP BY 1, 2 UNION ALL SELECT coll, ord, 'all' FROM ps WHERE n <= {budget})"


_ANY_ANCHOR = " OR ".join(f"contains(lower(text), '{a}')" for a in S.query_anchors(QUERY))
_HEADS = "list_slice(string_split(content, chr(10)), 1, 12)"
_N = "len(string_split(content, chr(10)))"
_MID = f"CASE WHEN {_N} > 16 THEN list_slice(string_split(content, chr(10)), 13, {_N} - 4) ELSE [] END"
_STR = Q._all(list(FIELDS)).replace("str AS (", "strx AS (", 1)

ORACLES = {
    "sel_dedup_content": _w("event_type", "flag") + _HASH + " SELECT coll, min(ord) AS ord FROM hs GROUP BY coll, h",
    "sel_novelty": _w("event_type", "props") + _HASH + ", z AS (SELECT *, count(*) OVER (PARTITION BY coll, h) AS size FROM hs) SELECT coll, ord, size, row_number() OVER (PARTITION BY coll ORDER BY size, ord)::INT AS novelty FROM z",
    "sel_dup_counts": _w("event_type", "flag", "number", "props") + ", c2 AS (SELECT * FROM c WHERE field IN ('event_type', 'flag'))" + _TXT.format("c2") + """, hs AS (SELECT coll, ord, md5(text) AS h FROM rt),
fm AS (SELECT coll, h, min(ord) AS ord, count(*) AS dup_count FROM hs GROUP BY 1, 2 HAVING count(*) > 1), sp AS (SELECT coll, h, field, count(DISTINCT s) AS k, min(s) AS v FROM c JOIN hs USING (coll, ord) WHERE field IN ('number', 'props') GROUP BY 1, 2, 3)
SELECT coll, ord, field, CASE WHEN k > 1 THEN '<varies>' ELSE v END AS shown, dup_count FROM fm JOIN sp USING (coll, h)""",
    "sel_singletons": _w("props", "event_type", "number") + _ONCE + " SELECT * FROM si",
    "sel_minority": _w("props", "event_type") + _ONCE + _POS + " SELECT si.* FROM si WHERE coll IN (SELECT coll FROM (SELECT coll, count(*) AS k FROM si GROUP BY 1) JOIN (SELECT coll, max(n) AS n FROM ps GROUP BY 1) USING (coll) WHERE 2 * k <= n)",
    "sel_density": _w() + _TXT.format("c") + _POS + """, nn AS (SELECT coll, max(n) AS n FROM ps GROUP BY 1), vs AS (SELECT coll, ord, 1.0 - count(*) OVER (PARTITION BY coll, field, s) / n AS r FROM c JOIN nn USING (coll) WHERE s IS NOT NULL), ra AS (SELECT coll, ord, avg(r) AS rare FROM vs GROUP BY 1, 2),
ln AS (SELECT coll, ord, length(text) AS len, min(length(text)) OVER (PARTITION BY coll) AS lo, max(length(text)) OVER (PARTITION BY coll) AS hi FROM rt),
hv AS (SELECT coll, field, count(*) >= 0.8 * max(n) AS common, count(*) < 0.2 * max(n) AS odd FROM c JOIN nn USING (coll) WHERE s IS NOT NULL GROUP BY 1, 2), kd AS (SELECT coll, sum(common::INT) AS nc, sum(odd::INT) AS no FROM hv GROUP BY 1),
ro AS (SELECT c.coll, c.ord, sum(common::INT) AS c, sum(odd::INT) AS o FROM c JOIN hv USING (coll, field) WHERE s IS NOT NULL GROUP BY 1, 2)
SELECT coll, ord, round(CASE WHEN n < 2 THEN 0.5 ELSE 0.4 * coalesce(rare, 0.5) + 0.3 * CASE WHEN hi > lo THEN (len - lo) / (hi - lo) ELSE 0.5 END + 0.3 * least(1.0, CASE WHEN no > 0 THEN 0.5 * coalesce(o, 0) / no ELSE 0 END + CASE WHEN nc > 0 THEN 0.5 * (nc - coalesce(c, 0)) / nc ELSE 0 END) END, 6) AS density
FROM ln LEFT JOIN ra USING (coll, ord) LEFT JOIN ro USING (coll, ord) LEFT JOIN kd USING (coll) JOIN nn USING (coll)""",
    "sel_anchors": _w("event_type") + _POS + _anchor_sql(24, "logs", "latest errors") + " SELECT * FROM anc",
    "sel_cluster": "WITH k AS (SELECT user_id AS coll, event_id AS ord, left(md5(left(props, 50)), 8) AS cluster FROM events) SELECT coll, ord, cluster FROM (SELECT *, row_number() OVER (PARTITION BY coll, cluster ORDER BY ord) AS r FROM k) WHERE r <= 2",
    "sel_top_n": "SELECT coll, ord, rank FROM (SELECT user_id AS coll, event_id AS ord, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INT AS rank FROM events) WHERE rank <= 12",
    "sel_time_series": (_w("value") + _POS + Q._changes(0.8)).replace("WITH", "WITH RECURSIVE", 1) + " SELECT DISTINCT ps.coll, ps.ord FROM ps JOIN ch ON ps.coll = ch.coll AND ps.pos BETWEEN ch.pos - 2 AND ch.pos + 2",
    "sel_query_anchors": "SELECT unnest(['4711', 'error', 'events.example.com']) AS anchor",
    "sel_anchor_rows": _w("event_type", "detail") + _TXT.format("c") + f" SELECT coll, ord FROM rt WHERE {_ANY_ANCHOR}",
    "sel_preserve_fields": "SELECT user_id AS coll, event_id AS ord FROM events WHERE contains(event_type, 'show error rows') OR contains('show error rows', event_type)",
    "sel_bigram_curve": _PAIRS + " SELECT * FROM cv",
    "sel_knee": _PAIRS + """, z AS (SELECT *, row_number() OVER (PARTITION BY coll ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY coll) AS n, min(seen) OVER (PARTITION BY coll) AS lo, max(seen) OVER (PARTITION BY coll) AS hi FROM cv),
d AS (SELECT coll, i, CASE WHEN hi > lo THEN round((seen - lo) / (hi - lo) - i / (n - 1), 9) END AS d FROM z WHERE n >= 3), m AS (SELECT coll, max(d) AS md FROM d GROUP BY 1)
SELECT m.coll, CASE WHEN md IS NULL THEN 1 WHEN md >= 0.05 THEN (SELECT min(i) FROM d WHERE d.coll = m.coll AND d.d = md) + 1 END AS knee FROM m""",
    "sel_k_split": "WITH k AS (SELECT o_orderkey, o_orderkey % 40 AS k FROM orders), a AS (SELECT *, least(greatest(1, round_even(k * 0.3, 0)), k)::BIGINT AS first FROM k), b AS (SELECT *, least(greatest(1, round_even(k * 0.15, 0)), k - first)::BIGINT AS last FROM a) SELECT o_orderkey, first, last, k - first - last AS rest FROM b",
    "sel_keep_budget": "SELECT o_orderkey, least(o_orderkey % 40, greatest(5, (o_orderkey % 40) // 2)) AS budget FROM orders",
    "sel_offload_gate": f"WITH {payloads.SQL} SELECT pid, length(content) >= 4000 AND kind != 'log' AND NOT regexp_matches(content, 'hash=[0-9a-f]{{12,24}}') AS offload FROM pay",
    "sel_offload": f"""WITH {payloads.SQL} SELECT pid, left(sha256(content), 24) AS hash_key, array_to_string({_HEADS}, chr(10)) AS head,
 array_to_string(list_slice(list_transform(list_filter({_MID}, lambda x: regexp_matches(x, '(?i)\\b(error|fatal|critical|panic|exception|traceback|failed)\\b')), lambda x: left(x, 240)), 1, 15), chr(10)) AS errors,
 array_to_string(CASE WHEN {_N} <= 12 THEN [] WHEN {_N} > 16 THEN list_slice(string_split(content, chr(10)), {_N} - 3, {_N}) ELSE list_slice(string_split(content, chr(10)), 13, {_N}) END, chr(10)) AS tail, {_N} AS n_lines
FROM pay WHERE length(content) >= 4000 AND NOT regexp_matches(content, 'hash=[0-9a-f]{{12,24}}')""",
    "sel_min_tokens_route": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 7 < o_orderkey % 5 THEN 'lossy' ELSE 'lossless' END AS route FROM orders",
    "sel_hamming": "SELECT l_orderkey, l_partkey, bit_count(xor(l_orderkey, l_partkey))::INT AS distance FROM lineitem",
    "sel_smart_sample": (_w() + _POS + _anchor_sql(15, "generic", "") + Q._ANOM + Q._changes(2.0) + Q._RARE + Q._STRUCT).replace("WITH", "WITH RECURSIVE", 1) + f""", tg AS (SELECT coll, ord, 'anchor' AS r FROM anc UNION SELECT coll, ord, 'error' FROM c WHERE {Q._ERR} UNION SELECT coll, ord, 'outlier' FROM so UNION SELECT coll, ord, 'anomaly' FROM an
 UNION SELECT ps.coll, ps.ord, 'change' FROM ps JOIN ch ON ps.coll = ch.coll AND ps.pos BETWEEN ch.pos - 1 AND ch.pos + 1) SELECT coll, ord, string_agg(r, ',' ORDER BY r) AS reasons FROM tg GROUP BY 1, 2""",
}
ORACLES["set_union_reasons"] = ORACLES["sel_smart_sample"]
