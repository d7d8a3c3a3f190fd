"""Queries over the profiling operators, and their SQL for the oracle.

The collections are users' events: at any scale a user has a bounded share of
them, so collections are many and no task holds the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.collections import cells, table
from sievelake.operators import profile as P
from sievelake.shared import written

FIELDS = ["event_type", "value", "props", "moment", "number", "detail", "rate", "flag"]


def event_rows(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Events with derived columns that exercise every rule: a counter, an ISO
    time, a rare text, a falling score and a constant. ``dealt``: partitioned by
    collection, so that no later step shuffles cells, eight to a row."""
    ev = table(spark, sf_dir, "events")
    return (ev.repartition("user_id") if dealt else ev).select(
        F.col("user_id").alias("coll"),
        F.col("event_id").alias("ord"),
        "event_type",
        "value",
        "props",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("moment"),
        F.col("event_id").alias("number"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 60), F.concat(F.lit("timeout after "), F.col("event_id").cast("string"))).alias("detail"),
        (F.lit(1.0) / (F.col("event_id") + 1)).alias("rate"),
        (F.col("value") >= 0).alias("flag"),
    )


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(event_rows(spark, sf_dir), "coll", FIELDS)


def profiled(spark: SparkSession, sf_dir: str, fields: list[str] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """(cells, stats) for operators that read both many times: the cells dealt
    out by collection, the statistics written once."""
    c = cells(event_rows(spark, sf_dir, dealt=True), "coll", fields)
    return c, written(P.field_stats(c))


def _rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, other.get(c, digits)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def q_field_stats(spark, sf):
    return _rounded(P.field_stats(event_cells(spark, sf)), 9, variance=3)


def q_schema_union(spark, sf):
    return P.schema_union(event_cells(spark, sf).where("kind != 'null'"))


def q_unique_ratio(spark, sf):
    return P.field_stats(event_cells(spark, sf)).select("coll", "field", F.round("unique_ratio", 9).alias("unique_ratio"))


def q_avg_length(spark, sf):
    return P.field_stats(event_cells(spark, sf)).where("avg_length is not null").select("coll", "field", F.round("avg_length", 9).alias("avg_length"))


def q_top_values(spark, sf):
    return P.top_values(event_cells(spark, sf).where("field in ('event_type', 'props')"))


def q_mean(spark, sf):
    return _rounded(P.moments(event_cells(spark, sf)).select("coll", "field", "mean"), 9)


def q_var(spark, sf):
    return P.moments(event_cells(spark, sf).where("field = 'value'")).select("coll", F.round("variance", 4).alias("variance"))


def q_stdev(spark, sf):
    return P.moments(event_cells(spark, sf).where("field = 'value'")).select("coll", F.round("stdev", 6).alias("stdev"))


def q_median(spark, sf):
    return _rounded(P.moments(event_cells(spark, sf).where("field in ('value', 'number')")).select("coll", "field", "median"))


def q_percentile(spark, sf):
    return _rounded(P.moments(event_cells(spark, sf).where("field in ('value', 'number')")).select("coll", "field", "p25", "p75"))


def q_entropy(spark, sf):
    return event_rows(spark, sf).select("ord", F.round(P.entropy(F.col("event_type")), 6).alias("type_entropy"), F.round(P.entropy(F.col("props")), 6).alias("props_entropy"))


def q_pattern(spark, sf):
    return P.patterns(*profiled(spark, sf))


def q_temporal(spark, sf):
    c = event_cells(spark, sf)
    return P.temporal(c, P.field_stats(c))


def q_change_points(spark, sf):
    return P.change_points(event_cells(spark, sf).where("field = 'value'"), sigmas=0.8).select("coll", "field", F.col("pos").cast("bigint").alias("pos"))


def q_id_field(spark, sf):
    c = event_cells(spark, sf)
    return P.id_fields(c, P.field_stats(c))


def q_score_field(spark, sf):
    c = event_cells(spark, sf)
    return _rounded(P.score_fields(c, P.field_stats(c)))


def q_sequential(spark, sf):
    orders = table(spark, sf, "orders").select((F.col("o_orderkey") % 50).alias("coll"), F.col("o_orderkey").alias("ord"), F.floor(F.col("o_orderkey") / 50).alias("n"), "o_totalprice")
    return P.sequential(cells(orders, "coll", ["n", "o_totalprice"]))


def q_uuid(spark, sf):
    key = F.md5(F.col("event_id").cast("string"))
    shaped = F.concat_ws("-", F.substring(key, 1, 8), F.substring(key, 9, 4), F.substring(key, 13, 4), F.substring(key, 17, 4), F.substring(key, 21, 12))
    text = F.when(F.col("event_id") % 3 == 0, shaped).otherwise(key)
    return table(spark, sf, "events").select("event_id", text.rlike(P.UUID).alias("is_uuid"))


def q_field_role(spark, sf):
    c = event_cells(spark, sf).where("field in ('event_type', 'value', 'moment', 'detail', 'flag')")
    return P.field_roles(c, P.field_stats(c))


def q_exclude_set(spark, sf):
    c = event_cells(spark, sf).where("field in ('event_type', 'value', 'moment', 'number')")
    return P.field_roles(c, P.field_stats(c)).where("role = 'varying-identity'").select("coll", "field")


def q_crushability(spark, sf):
    return P.crushability(*profiled(spark, sf, ["event_type", "value", "detail"]))


def q_strategy(spark, sf):
    return P.strategies(*profiled(spark, sf)).select("coll", "pattern", "strategy")


def q_est_reduction(spark, sf):
    return P.strategies(*profiled(spark, sf)).select("coll", F.round("est_reduction", 6).alias("est_reduction"))


def q_numeric_stats(spark, sf):
    return _rounded(P.numeric_stats(event_cells(spark, sf).where("field in ('value', 'number')")), 4)


def q_anomalies(spark, sf):
    return P.anomalies(event_cells(spark, sf).where("field = 'value'")).select("coll", "field", "ord", F.round("x", 4).alias("x"))


def q_error_rows(spark, sf):
    return P.error_rows(event_cells(spark, sf).where("field in ('event_type', 'detail') and kind != 'null'"))


def q_rare_status(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("coll"), F.monotonically_increasing_id().alias("ord"), F.when(F.col("l_quantity") > 49, "big").when(F.col("l_quantity") > 48, "large").otherwise("usual").alias("size"), "l_returnflag")
    return P.rare_status(cells(rows, "coll", ["size", "l_returnflag"])).groupBy("coll", "field", "value").agg(F.count("*").alias("n"))


def q_outlier_struct(spark, sf):
    return P.structural_outliers(event_cells(spark, sf).where("field in ('event_type', 'value', 'detail') and kind != 'null'"))


QUERIES = {
    "agg_field_stats": q_field_stats, "agg_schema_union": q_schema_union, "agg_unique_ratio": q_unique_ratio, "agg_top_values": q_top_values,
    "agg_avg_length": q_avg_length, "agg_mean": q_mean, "agg_var": q_var, "agg_stdev": q_stdev, "agg_median": q_median, "agg_percentile": q_percentile,
    "agg_entropy": q_entropy, "agg_pattern": q_pattern, "agg_temporal": q_temporal, "agg_change_points": q_change_points, "agg_id_field": q_id_field,
    "agg_score_field": q_score_field, "agg_sequential": q_sequential, "agg_uuid": q_uuid, "agg_field_role": q_field_role, "agg_exclude_set": q_exclude_set,
    "agg_crushability": q_crushability, "agg_strategy": q_strategy, "agg_est_reduction": q_est_reduction, "agg_numeric_stats": q_numeric_stats,
    "sel_anomalies": q_anomalies, "sel_error_rows": q_error_rows, "sel_rare_status": q_rare_status, "sel_outlier_struct": q_outlier_struct,
}

_ROWS = """
ev AS (SELECT user_id AS coll, event_id AS ord, event_type, value, props, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment, event_id AS number,
  CASE WHEN event_type = 'error' AND value > 60 THEN 'timeout after ' || event_id END AS detail, 1.0::DOUBLE / (event_id + 1) AS rate, value >= 0 AS flag FROM events)
"""


def _cell(f: str, kind: str) -> str:
    x = f"{f}::DOUBLE" if kind == "numeric" else "NULL::DOUBLE"
    s = f"CASE WHEN {f} THEN 'True' WHEN NOT {f} THEN 'False' END" if kind == "boolean" else f"{f}::VARCHAR"
    return f"SELECT coll, ord, '{f}' AS field, CASE WHEN {f} IS NULL THEN 'null' ELSE '{kind}' END AS kind, {s} AS s, {x} AS x FROM ev"


_KINDS = {"event_type": "string", "value": "numeric", "props": "string", "moment": "string", "number": "numeric", "detail": "string", "rate": "numeric", "flag": "boolean"}


def _with(fields=None, extra: str = "") -> str:
    return "WITH " + _ROWS + ", c AS (" + " UNION ALL ".join(_cell(f, _KINDS[f]) for f in fields or FIELDS) + "), " + _STATS + extra


_STATS = """
f AS (SELECT coll, field, arg_min(kind, ord) FILTER (kind != 'null') AS ft, arg_min(s, ord) FILTER (kind != 'null') AS fs, count(*) AS n, count(DISTINCT coalesce(s, 'None')) AS u,
  min(x) AS mn, max(x) AS mx, avg(x) AS mean, coalesce(var_samp(x), 0) AS var, avg(length(s)) FILTER (kind = 'string') AS al FROM c GROUP BY 1, 2),
st AS (SELECT coll, field, coalesce(ft, 'null') AS field_type, n AS count, CASE WHEN ft IS NULL THEN 0 ELSE u END AS unique_count, CASE WHEN ft IS NULL THEN 0 ELSE u / n END AS unique_ratio,
  ft IS NULL OR u = 1 AS is_constant, CASE WHEN u = 1 THEN fs END AS constant_value, CASE WHEN ft = 'numeric' THEN mn END AS min_val, CASE WHEN ft = 'numeric' THEN mx END AS max_val,
  CASE WHEN ft = 'numeric' THEN mean END AS mean_val, CASE WHEN ft = 'numeric' THEN var END AS variance, CASE WHEN ft = 'string' THEN al END AS avg_length FROM f)
"""
_ENT = """CASE WHEN length({0}) >= 2 AND len(list_distinct(string_split({0}, ''))) >= 2 THEN
 (SELECT -sum(k / length({0}) * log2(k / length({0}))) / log2(count(*)) FROM (SELECT count(*) AS k FROM (SELECT unnest(string_split({0}, '')) AS ch) GROUP BY ch)) ELSE 0 END"""
_ISO_T = r"regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}')"
_ISO_D = r"regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')"
_UUID = r"'^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$'"


def _seq(name: str, src: str) -> str:
    return f"""{name} AS (SELECT coll, field, count(*) >= 5 AND avg(step) BETWEEN 0.5 AND 2 AND avg(CASE WHEN step IS NOT NULL THEN (step BETWEEN 0.5 AND 2)::INT END) > 0.8 AND avg((x >= p)::INT) > 0.7 AS is_sequential
  FROM (SELECT *, x - lag(x) OVER (PARTITION BY coll, field ORDER BY x, ord) AS step, lag(x) OVER (PARTITION BY coll, field ORDER BY ord) AS p FROM {src} WHERE x IS NOT NULL) GROUP BY 1, 2)"""


_TEMPORAL = f""", t10 AS (SELECT coll, field, avg(({_ISO_T} OR {_ISO_D})::INT) AS iso FROM (SELECT *, row_number() OVER (PARTITION BY coll, field ORDER BY ord) AS rn FROM c) WHERE rn <= 10 AND kind = 'string' GROUP BY 1, 2),
tmp AS (SELECT st.coll, st.field, coalesce(CASE WHEN field_type = 'string' THEN iso > 0.5 WHEN field_type = 'numeric' THEN (min_val BETWEEN 1e9 AND 2e9 AND max_val BETWEEN 1e9 AND 2e9) OR (min_val BETWEEN 1e12 AND 2e12 AND max_val BETWEEN 1e12 AND 2e12) END, FALSE) AS is_temporal
  FROM st LEFT JOIN t10 USING (coll, field))"""
_SCORE = (
    ", h50 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coll, field ORDER BY ord) AS rn FROM c) WHERE rn <= 50), "
    + _seq("sq50", "h50")
    + """, shp AS (SELECT coll, field, count(*) AS k, avg((p >= x)::INT) AS falling, avg(CASE WHEN pos <= 20 THEN (x != trunc(x))::INT END) AS fraction
  FROM (SELECT *, row_number() OVER w AS pos, lag(x) OVER w AS p FROM c WHERE x IS NOT NULL WINDOW w AS (PARTITION BY coll, field ORDER BY ord)) GROUP BY 1, 2),
sc0 AS (SELECT st.*, CASE WHEN min_val >= 0 AND max_val <= 1 THEN 0.4 WHEN min_val >= 0 AND max_val <= 10 THEN 0.3 WHEN min_val >= 0 AND max_val <= 100 THEN 0.25 WHEN min_val >= -1 AND max_val <= 1 THEN 0.35 END AS base, k, falling, fraction, is_sequential AS sq
  FROM st LEFT JOIN shp USING (coll, field) LEFT JOIN sq50 USING (coll, field) WHERE field_type = 'numeric'),
sc1 AS (SELECT coll, field, CASE WHEN unique_count > 1 AND variance > 0 AND base IS NOT NULL AND NOT coalesce(sq, FALSE) THEN base + CASE WHEN k >= 5 AND falling > 0.7 THEN 0.3 ELSE 0 END + CASE WHEN fraction > 0.3 THEN 0.1 ELSE 0 END ELSE 0 END::DOUBLE AS conf FROM sc0),
scr AS (SELECT coll, field, conf >= 0.4 - 1e-9 AS is_score, least(conf, 0.95) AS confidence FROM sc1)"""
)
_PATTERN = """, pat AS (SELECT coll, CASE WHEN bool_or(is_temporal) AND bool_or(coalesce(field_type = 'numeric' AND variance > 0, FALSE)) THEN 'time_series'
  WHEN bool_or(coalesce(field_type = 'string' AND unique_ratio > 0.5 AND avg_length > 20, FALSE)) AND bool_or(coalesce(field_type = 'string' AND NOT (unique_ratio > 0.5 AND avg_length > 20) AND unique_ratio < 0.1 AND unique_count BETWEEN 2 AND 10, FALSE)) THEN 'logs'
  WHEN bool_or(coalesce(is_score AND confidence >= 0.5, FALSE)) THEN 'search_results' ELSE 'generic' END AS pattern
  FROM st JOIN tmp USING (coll, field) LEFT JOIN scr USING (coll, field) GROUP BY 1)"""
_IDS = (
    ", "
    + _seq("sq", "c")
    + f""", h20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coll, field ORDER BY ord) AS rn FROM c) WHERE rn <= 20 AND kind = 'string'),
e20 AS (SELECT coll, field, ord, s, {_ENT.format("s")} AS ent FROM h20),
s20 AS (SELECT coll, field, avg(regexp_matches(s, {_UUID})::INT) AS uuid, avg(ent) AS ent FROM e20 GROUP BY 1, 2),
idf AS (SELECT coll, field, unique_ratio, (CASE WHEN unique_ratio < 0.9 THEN 0.0 WHEN field_type = 'string' AND uuid > 0.8 THEN 0.95 WHEN field_type = 'string' AND ent > 0.7 AND unique_ratio > 0.95 THEN 0.8
  WHEN field_type = 'numeric' AND is_sequential AND unique_ratio > 0.95 THEN 0.9 WHEN field_type = 'numeric' AND max_val > min_val AND unique_ratio > 0.95 THEN 0.85 WHEN unique_ratio > 0.98 THEN 0.7 ELSE 0.0 END)::DOUBLE AS confidence
  FROM st LEFT JOIN s20 USING (coll, field) LEFT JOIN sq USING (coll, field))"""
)
_ANOM = """, an AS (SELECT c.coll, c.field, c.ord, c.x FROM c JOIN (SELECT coll, field, avg(x) AS m, stddev_samp(x) AS sd FROM c WHERE x IS NOT NULL GROUP BY 1, 2) s USING (coll, field) WHERE sd > 0 AND abs(x - m) > 2 * sd)"""


def _changes(sigmas: float, src: str = "c") -> str:
    return f""", cw AS (SELECT coll, field, row_number() OVER w - 1 AS pos, avg(x) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, avg(x) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a,
  count(*) OVER (PARTITION BY coll, field) AS n, stddev_samp(x) OVER (PARTITION BY coll, field) AS sd FROM {src} WHERE x IS NOT NULL WINDOW w AS (PARTITION BY coll, field ORDER BY ord)),
cc AS (SELECT coll, field, pos FROM cw WHERE pos >= 5 AND pos < n - 5 AND sd > 0 AND abs(a - b) > {sigmas} * sd),
ch AS (SELECT coll, field, min(pos) AS pos FROM cc GROUP BY 1, 2 UNION ALL SELECT ch.coll, ch.field, (SELECT min(cc.pos) FROM cc WHERE cc.coll = ch.coll AND cc.field = ch.field AND cc.pos - ch.pos > 5) FROM ch
  WHERE EXISTS (SELECT 1 FROM cc WHERE cc.coll = ch.coll AND cc.field = ch.field AND cc.pos - ch.pos > 5))"""


_RARE = """, vc AS (SELECT coll, field, coalesce(s, '__none__') AS v, count(*) AS c, max((kind != 'null')::INT) AS known FROM c GROUP BY 1, 2, 3),
rk AS (SELECT *, sum(c) OVER (PARTITION BY coll, field) AS total, sum(known) OVER (PARTITION BY coll, field) AS kinds, coalesce(sum(c) OVER (PARTITION BY coll, field ORDER BY c DESC, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM vc),
tk AS (SELECT *, ahead < ceil(total * 0.8) AS top, sum((ahead < ceil(total * 0.8))::INT) OVER (PARTITION BY coll, field) AS n_top FROM rk),
sz AS (SELECT coll, count(DISTINCT ord) AS n FROM c GROUP BY 1),
rv AS (SELECT coll, field, v FROM tk JOIN sz USING (coll) WHERE kinds BETWEEN 2 AND 50 AND n_top <= 5 AND total >= 0.8 * n AND NOT top),
rs AS (SELECT c.coll, c.ord, c.field, rv.v AS value FROM c JOIN rv ON c.coll = rv.coll AND c.field = rv.field AND coalesce(c.s, '__none__') = rv.v)"""
_STRUCT = """, pc AS (SELECT coll, field, count(*) AS k FROM c WHERE kind != 'null' GROUP BY 1, 2),
so AS (SELECT c.coll, c.ord FROM c JOIN pc USING (coll, field) JOIN sz USING (coll) WHERE c.kind != 'null' AND n >= 5 AND k < 0.2 * n UNION SELECT coll, ord FROM rs JOIN sz USING (coll) WHERE n >= 5)"""
_ERR = "regexp_matches(lower(concat_ws(' ', field, s)), 'error|exception|failed|failure|critical|fatal|crash|panic|abort|timeout|denied|rejected')"
_CRUSH = """, bi AS (SELECT coll, field AS idf, unique_ratio AS ir, confidence AS ic FROM (SELECT *, row_number() OVER (PARTITION BY coll ORDER BY confidence DESC, field) AS rn FROM idf WHERE confidence > 0) WHERE rn = 1),
un AS (SELECT st.coll, coalesce(avg(unique_ratio) FILTER (field_type = 'string'), 0) AS us, coalesce(avg(unique_ratio) FILTER (field_type = 'numeric'), 0) AS un FROM st LEFT JOIN bi USING (coll) WHERE field IS DISTINCT FROM idf GROUP BY 1),
cr AS (SELECT k.coll, coalesce(us, 0) AS us, coalesce(un, 0) AS un, coalesce(ir, 0) AS ir, coalesce(ic, 0) >= 0.7 AS has_id,
  k.coll IN (SELECT coll FROM scr WHERE is_score) OR k.coll IN (SELECT coll FROM so) OR k.coll IN (SELECT coll FROM c WHERE ERR) OR k.coll IN (SELECT coll FROM an) OR k.coll IN (SELECT coll FROM ch) AS sig
  FROM (SELECT DISTINCT coll FROM st) k LEFT JOIN bi USING (coll) LEFT JOIN un USING (coll)),
cs AS (SELECT coll, CASE WHEN greatest(us, un) < 0.1 AND has_id THEN 0 WHEN greatest(us, ir) < 0.3 THEN 1 WHEN has_id AND greatest(us, ir) > 0.8 AND NOT sig THEN 2 WHEN greatest(us, ir) > 0.8 AND sig THEN 3 WHEN NOT sig THEN 4 ELSE 5 END AS k FROM cr),
crush AS (SELECT coll, k NOT IN (2, 4) AS crushable, ([0.85, 0.9, 0.85, 0.7, 0.6, 0.5][k + 1])::DOUBLE AS confidence,
  ['repetitive_content_with_ids', 'low_uniqueness_safe_to_sample', 'unique_entities_no_signal', 'unique_entities_with_signal', 'medium_uniqueness_no_signal', 'medium_uniqueness_with_signal'][k + 1] AS reason FROM cs)""".replace("ERR", _ERR)
_STRAT = """, str AS (SELECT pat.coll, pattern, CASE WHEN n < 5 THEN 'none' WHEN NOT crushable THEN 'skip' WHEN pattern = 'time_series' AND pat.coll IN (SELECT coll FROM ch) THEN 'time_series'
  WHEN pattern = 'logs' AND msg < 0.5 THEN 'cluster_sample' WHEN pattern = 'search_results' THEN 'top_n' ELSE 'smart_sample' END AS strategy, const
  FROM pat JOIN crush USING (coll) JOIN (SELECT coll, max(count) AS n, avg(is_constant::INT) AS const, arg_min(unique_ratio, field) FILTER (lower(field) LIKE '%message%') AS msg FROM st GROUP BY 1) z USING (coll))"""
_RW = "WITH RECURSIVE"


def _all(fields=None, sigmas: float = 2.0) -> str:
    return _with(fields, _TEMPORAL + _SCORE + _PATTERN + _IDS + _ANOM + _changes(sigmas) + _RARE + _STRUCT + _CRUSH + _STRAT).replace("WITH", _RW, 1)


ORACLES = {
    "agg_field_stats": _with() + """SELECT coll, field, field_type, count, CAST(unique_count AS BIGINT) AS unique_count, round(unique_ratio, 9) AS unique_ratio, is_constant, constant_value, round(min_val, 9) AS min_val, round(max_val, 9) AS max_val,
  round(mean_val, 9) AS mean_val, round(variance, 3) AS variance, round(avg_length, 9) AS avg_length FROM st""",
    "agg_schema_union": _with() + "SELECT DISTINCT coll, field FROM c WHERE kind != 'null'",
    "agg_unique_ratio": _with() + "SELECT coll, field, round(unique_ratio, 9) AS unique_ratio FROM st",
    "agg_avg_length": _with() + "SELECT coll, field, round(avg_length, 9) AS avg_length FROM st WHERE avg_length IS NOT NULL",
    "agg_top_values": _with(["event_type", "props"]) + """SELECT coll, field, CAST(rank AS INT) AS rank, value, n FROM (SELECT coll, field, s AS value, count(*) AS n, row_number() OVER (PARTITION BY coll, field ORDER BY count(*) DESC, min(ord)) AS rank
  FROM c WHERE kind = 'string' GROUP BY 1, 2, 3) WHERE rank <= 5""",
    "agg_mean": _with() + "SELECT coll, field, round(avg(x), 9) AS mean FROM c WHERE x IS NOT NULL GROUP BY 1, 2",
    "agg_var": "SELECT user_id AS coll, round(var_samp(value), 4) AS variance FROM events GROUP BY 1",
    "agg_stdev": "SELECT user_id AS coll, round(stddev_samp(value), 6) AS stdev FROM events GROUP BY 1",
    "agg_median": _with(["value", "number"]) + "SELECT coll, field, round(median(x), 6) AS median FROM c GROUP BY 1, 2",
    "agg_percentile": _with(["value", "number"]) + "SELECT coll, field, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.75), 6) AS p75 FROM c GROUP BY 1, 2",
    "agg_entropy": f"SELECT event_id AS ord, round({_ENT.format('event_type')}, 6) AS type_entropy, round({_ENT.format('props')}, 6) AS props_entropy FROM events",
    "agg_pattern": _with(None, _TEMPORAL + _SCORE + _PATTERN) + "SELECT coll, pattern FROM pat",
    "agg_temporal": _with(None, _TEMPORAL) + "SELECT * FROM tmp",
    "agg_change_points": _with(["value"], _changes(0.8)).replace("WITH", _RW, 1) + "SELECT coll, field, pos FROM ch",
    "agg_id_field": _with(None, _IDS) + "SELECT coll, field, confidence > 0 AS is_id, confidence FROM idf",
    "agg_score_field": _with(None, _SCORE) + "SELECT coll, field, is_score, round(confidence, 6) AS confidence FROM scr",
    "agg_sequential": "WITH c AS (SELECT o_orderkey % 50 AS coll, o_orderkey AS ord, 'n' AS field, floor(o_orderkey / 50)::DOUBLE AS x FROM orders UNION ALL SELECT o_orderkey % 50, o_orderkey, 'o_totalprice', o_totalprice FROM orders), " + _seq("sq", "c") + " SELECT * FROM sq",
    "agg_uuid": f"""WITH k AS (SELECT event_id, md5(event_id::VARCHAR) AS k FROM events)
SELECT event_id, regexp_matches(CASE WHEN event_id % 3 = 0 THEN substr(k, 1, 8) || '-' || substr(k, 9, 4) || '-' || substr(k, 13, 4) || '-' || substr(k, 17, 4) || '-' || substr(k, 21, 12) ELSE k END, {_UUID}) AS is_uuid FROM k""",
    "agg_exclude_set": _with(["event_type", "value", "moment", "number"], _IDS) + f"""SELECT coll, field FROM st JOIN (SELECT coll, field, avg(({_ISO_T} OR {_ISO_D})::INT) AS iso FROM h20 GROUP BY 1, 2) USING (coll, field) WHERE NOT is_constant AND unique_ratio >= 0.9 AND iso >= 0.8
UNION ALL SELECT st.coll, st.field FROM st JOIN sq USING (coll, field) WHERE unique_ratio >= 0.9 AND is_sequential""",
    "agg_crushability": _all(["event_type", "value", "detail"]) + "SELECT * FROM crush",
    "agg_strategy": _all() + "SELECT coll, pattern, strategy FROM str",
    "agg_est_reduction": _all() + """SELECT coll, round(CASE WHEN strategy IN ('none', 'skip') THEN 0 ELSE least(CASE strategy WHEN 'time_series' THEN 0.7 WHEN 'cluster_sample' THEN 0.8 WHEN 'top_n' THEN 0.6 ELSE 0.5 END + const * 0.2, 0.95) END::DOUBLE, 6) AS est_reduction FROM str""",
    "agg_numeric_stats": _with(["value", "number"]) + "SELECT coll, field, round(min(x), 4) AS min, round(max(x), 4) AS max, round(sum(s::DECIMAL(30, 6))::DOUBLE, 4) AS sum, count(*) AS count FROM c GROUP BY 1, 2",
    "sel_anomalies": _with(["value"], _ANOM) + "SELECT coll, field, ord, round(x, 4) AS x FROM an",
    "sel_error_rows": _with(["event_type", "detail"]) + f"SELECT DISTINCT coll, ord FROM c WHERE kind != 'null' AND {_ERR}",
    "sel_rare_status": """WITH l AS (SELECT l_suppkey AS coll, row_number() OVER () AS ord, CASE WHEN l_quantity > 49 THEN 'big' WHEN l_quantity > 48 THEN 'large' ELSE 'usual' END AS size, l_returnflag FROM lineitem),
c AS (SELECT coll, ord, 'size' AS field, 'string' AS kind, size AS s FROM l UNION ALL SELECT coll, ord, 'l_returnflag', 'string', l_returnflag FROM l)""" + _RARE + "SELECT coll, field, value, count(*) AS n FROM rs GROUP BY 1, 2, 3",
    "sel_outlier_struct": "WITH " + _ROWS + ", c AS (" + "SELECT * FROM (" + " UNION ALL ".join(_cell(f, _KINDS[f]) for f in ("event_type", "value", "detail")) + ") WHERE kind != 'null')" + _RARE + _STRUCT + "SELECT * FROM so",
}
