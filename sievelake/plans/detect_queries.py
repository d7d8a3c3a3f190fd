"""Queries over the detectors, on texts of every type."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.collections import table
from sievelake.functions import text as T
from sievelake.operators import detect as D
from sievelake.plans import payloads as P


def _r(c):
    return F.round(c, 6)


def _conf(f):
    def q(spark, sf):
        return P.payloads(spark, sf).select("pid", _r(f(F.col("content"))).alias("confidence")).where("confidence is not null")

    return q


def q_content_type(spark, sf):
    return P.payloads(spark, sf).select("pid", D.content_type(F.col("content")).alias("t")).select("pid", "t.content_type", "t.confidence")


def q_code(spark, sf):
    return P.payloads(spark, sf).select("pid", D.code_language(F.col("content")).alias("c")).where("c is not null").select("pid", _r(F.col("c.confidence")).alias("confidence"), "c.language")


def q_array_kind(spark, sf):
    ev = table(spark, sf, "events")
    val = F.when(F.col("user_id") % 5 == 0, F.to_json(F.struct("event_id"))).when(F.col("user_id") % 5 == 1, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(F.col("user_id") % 5 == 2, F.col("event_id").cast("string")).when(F.col("user_id") % 5 == 3, F.lit("true")).otherwise(F.when(F.col("event_id") % 2 == 0, "1").otherwise('"x"'))
    arr = ev.groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(val), ","), F.lit("]")).alias("j"))
    items = F.try_variant_get(F.try_parse_json("j"), "$", "array<variant>")
    return arr.select("user_id", D.array_kind(items).alias("kind"))


def q_cell_class(spark, sf):
    d = table(spark, sf, "documents")
    v = F.when(F.col("doc_id") % 4 == 0, F.base64(F.sha2(F.col("doc_id").cast("string"), 256).cast("binary"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("<p><b>"), F.col("doc_id").cast("string"), F.lit("</b><i>"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit('{"a": '), F.col("doc_id").cast("string"), F.lit("}"))).otherwise(F.col("text"))
    return d.select("doc_id", D.cell_class(v).alias("cls")).where("cls is not null")


def q_strategy_map(spark, sf):
    return P.payloads(spark, sf).select("pid", D.strategy_of(D.content_type(F.col("content"))["content_type"]).alias("strategy"))


def q_min_ratio(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", _r(D.min_ratio(F.col("c_acctbal") / 5000.0)).alias("min_ratio"))


def q_disposition(spark, sf):
    m = D.message_disposition(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    return m.select("conv_id", "turn", "disposition")


def q_tool_excluded(spark, sf):
    return table(spark, sf, "part").select("p_partkey", D.tool_excluded(F.col("p_name"), ("red *", "*bolt", "small ring")).alias("excluded"))


def q_analysis_intent(spark, sf):
    return P.payloads(spark, sf).select("pid", D.analysis_intent(F.col("content")).alias("intent"))


def q_error_strong(spark, sf):
    return P.payloads(spark, sf).select("pid", (T.error_indicator_count(F.col("content")) >= 2).alias("strong"))


def q_error_any(spark, sf):
    return P.payloads(spark, sf).select("pid", (T.error_indicator_count(F.col("content")) >= 1).alias("found"))


def q_line_score(spark, sf):
    rows = P.payloads(spark, sf).where("kind in ('log', 'code', 'text')").select("pid", F.posexplode(T.lines(F.col("content"))).alias("line_no", "line"))
    cat = T.line_category(F.col("line"))
    return rows.select("pid", F.col("line_no").cast("bigint").alias("line_no"), cat.alias("category"), T.line_priority(cat).alias("priority"), F.when(cat.isNotNull(), T.CONFIDENCE).otherwise(0.0).alias("confidence")).where("category is not null")


def q_secret(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.has_prefixed_secret(t).alias("prefixed"), T.has_entropy_secret(t).alias("entropy"))


def q_volatile(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "token"))
    kinds = words.withColumn("kind", T.volatile_kind(F.col("token"))).where("kind is not null")
    return kinds.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token", "kind")


def q_html(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("src"), F.col("html").alias("t"))
    docs = table(spark, sf, "documents").select(F.col("doc_id"), F.lit("doc"), F.col("text"))
    return pages.union(docs).select("id", "src", D.is_html(F.col("t")).alias("is_html"))


QUERIES = {
    "det_content_type": q_content_type, "det_json": _conf(D.json_confidence), "det_diff": _conf(D.diff_confidence), "det_rust_diff": _conf(D.diff_confidence),
    "det_search": _conf(D.search_confidence), "det_log": _conf(D.log_confidence), "det_code": q_code, "det_array_kind": q_array_kind, "det_cell_class": q_cell_class,
    "det_strategy_map": q_strategy_map, "det_min_ratio": q_min_ratio, "det_message_disposition": q_disposition, "det_tool_excluded": q_tool_excluded,
    "det_analysis_intent": q_analysis_intent, "det_error_strong": q_error_strong, "det_error_any": q_error_any, "det_line_score": q_line_score,
    "det_secret": q_secret, "det_volatile": q_volatile, "src_html_sniff": q_html,
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _count(ls: str, pattern: str) -> str:
    return f"len(list_filter({ls}, lambda x: regexp_matches(x, {_q(pattern)})))"


_LS = "string_split(content, chr(10))"
_H500, _H100, _H200 = (f"list_slice({_LS}, 1, {n})" for n in (500, 100, 200))
_FILLED100, _FILLED200 = (f"len(list_filter({h}, lambda x: trim(x) != ''))" for h in (_H100, _H200))
_OBJ = "len({0}) > 0 AND len(list_filter({0}, lambda x: json_type(x) != 'OBJECT')) = 0"
_TRY = "CASE WHEN json_valid(trim(content)) THEN json(trim(content)) END"
_JSON = f"CASE WHEN starts_with(trim(content), '[') AND json_valid(trim(content)) THEN CASE WHEN {_OBJ.format('(json(trim(content))::JSON[])')} THEN 1.0 ELSE 0.8 END END"
_DIFF = f"CASE WHEN {_count(_H500, D.DIFF_HEADER)} > 0 THEN least(1.0, 0.5 + {_count(_H500, D.DIFF_HEADER)} * 0.2 + {_count(_H500, D.DIFF_CHANGE)} * 0.05) END"
_SHITS = f"len(list_filter({_H100}, lambda x: trim(x) != '' AND regexp_matches(x, {_q(D.SEARCH_LINE)})))"
_SEARCH = f"CASE WHEN {_SHITS} > 0 AND {_SHITS} / {_FILLED100} >= 0.3 THEN least(1.0, 0.4 + {_SHITS} / {_FILLED100} * 0.6) END"
_LE = D.any_of((D.LOG_ERROR.replace("(?i)", "(?i:") + ")", D.LOG_WARN.replace("(?i)", "(?i:") + ")"))
_LALL = D.any_of((D.LOG_ERROR.replace("(?i)", "(?i:") + ")", D.LOG_WARN.replace("(?i)", "(?i:") + ")", *D.LOG_OTHER))
_LOG = f"CASE WHEN {_count(_H200, _LALL)} > 0 AND {_count(_H200, _LALL)} / {_FILLED200} >= 0.1 THEN least(1.0, 0.3 + {_count(_H200, _LALL)} / {_FILLED200} * 0.5 + {_count(_H200, _LE)} * 0.05) END"
_CODES = "list_value(" + ", ".join(f"struct_pack(n := {_count(_H100, D.any_of(p))}, r := {-i}, lang := '{lang}')" for i, (lang, p) in enumerate(D.CODE.items())) + ")"
_DET = (
    f"WITH {P.SQL}, cd AS MATERIALIZED (SELECT pid, list_max({_CODES}) AS b FROM pay), "
    + f"k0 AS MATERIALIZED (SELECT pay.pid, pay.content, {_JSON} AS j, {_DIFF} AS d, {_SEARCH} AS s, {_LOG} AS l, CASE WHEN b.n >= 3 THEN least(1.0, 0.4 + b.n / greatest({_FILLED100}, 1) * 0.4 + b.n * 0.02) END AS c, b.lang AS lang, "
    + "kind FROM pay JOIN cd USING (pid)), "
    + f"""dl AS MATERIALIZED (SELECT pid, content, list_filter(string_split(trim(content, ' '), chr(10)), lambda x: trim(x) != '') AS ls, d FROM pay CROSS JOIN (SELECT unnest([',', chr(9), ';']) AS d)),
ds AS MATERIALIZED (SELECT pid, d, len(string_split(ls[1], d)) AS n, len(list_filter(list_slice(ls, 1, 200), lambda x: len(string_split(x, d)) = len(string_split(ls[1], d)))) / len(list_slice(ls, 1, 200)) AS ratio, len(ls) AS k, length(content) AS sz, content FROM dl WHERE len(ls) > 0),
dk AS (SELECT *, rank() OVER (PARTITION BY pid ORDER BY ratio DESC, n DESC) AS rk, count(*) OVER (PARTITION BY pid, ratio, n) AS ties FROM ds WHERE n >= 2 AND ratio >= 0.9),
csv AS MATERIALIZED (SELECT pid, d FROM dk WHERE rk = 1 AND ties = 1 AND sz >= 200 AND k >= 6 AND NOT regexp_matches(trim(content), '^[\\[{{<]')),
ct AS (SELECT pid, CASE WHEN coalesce(trim(content), '') = '' THEN 'text' WHEN j IS NOT NULL OR kind = 'envelope' THEN 'json_array' WHEN d >= 0.7 THEN 'diff' WHEN s >= 0.6 THEN 'search' WHEN pid IN (SELECT pid FROM csv) THEN 'json_array'
  WHEN l >= 0.5 THEN 'build' WHEN c >= 0.5 THEN 'source_code' ELSE 'text' END AS content_type,
  round(CASE WHEN coalesce(trim(content), '') = '' THEN 0.0 WHEN j IS NOT NULL THEN j WHEN kind = 'envelope' THEN 0.9 WHEN d >= 0.7 THEN d WHEN s >= 0.6 THEN s WHEN pid IN (SELECT pid FROM csv) THEN 0.9 WHEN l >= 0.5 THEN l WHEN c >= 0.5 THEN c ELSE 0.5 END, 6)::DOUBLE AS confidence FROM k0) """
)


def _one(expr: str) -> str:
    return f"WITH {P.SQL} SELECT * FROM (SELECT pid, round(({expr})::DOUBLE, 6) AS confidence FROM pay) WHERE confidence IS NOT NULL"


_IND = " + ".join(f"contains(lower(content), '{w}')::INT" for w in T.ERROR_INDICATORS)
_UNI = T.word_pattern(T.ERROR_WORDS + T.IMPORTANCE_WORDS)
_ERRS = "(" + ", ".join(f"'{w}'" for w in T.ERROR_WORDS) + ")"
_MD = " OR ".join(f"starts_with(line, '{p}')" for p in T.MARKDOWN_PREFIXES)
_BITS = "(SELECT -sum(k / length({0}) * log2(k / length({0}))) FROM (SELECT count(*) AS k FROM (SELECT unnest(string_split({0}, '')) AS ch) GROUP BY ch))"

ORACLES = {
    "det_content_type": _DET + "SELECT * FROM ct",
    "det_json": _one(_JSON), "det_diff": _one(_DIFF), "det_rust_diff": _one(_DIFF), "det_search": _one(_SEARCH), "det_log": _one(_LOG),
    "det_code": _DET + "SELECT pid, round(c::DOUBLE, 6) AS confidence, lang AS language FROM k0 WHERE c IS NOT NULL",
    "det_array_kind": "SELECT user_id, (['dict_array', 'string_array', 'number_array', 'bool_array', CASE WHEN count(DISTINCT event_id % 2) = 2 THEN 'mixed_array' WHEN max(event_id % 2) = 0 THEN 'number_array' ELSE 'string_array' END])[user_id % 5 + 1] AS kind FROM events GROUP BY user_id",
    "det_cell_class": """WITH v AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN base64(sha256(doc_id::VARCHAR)::BLOB) WHEN 1 THEN '<p><b>' || doc_id || '</b><i>' WHEN 2 THEN '{"a": ' || doc_id || '}' ELSE text END AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(trim(t), '^[\\[{]') AND json_valid(t) THEN 'json'
  WHEN length(t) >= 64 AND length(regexp_replace(t, '[^A-Za-z0-9+/=]', '', 'g')) >= 0.95 * length(t) AND len(list_distinct(string_split(regexp_replace(t, '=+$', ''), ''))) >= 16 THEN 'base64'
  WHEN len(regexp_extract_all(t, '<[A-Za-z]')) >= 3 THEN 'html' WHEN strlen(t) > 256 THEN 'long' ELSE 'scalar' END AS cls FROM v""",
    "det_strategy_map": _DET + "SELECT pid, CASE content_type WHEN 'json_array' THEN 'smart_crusher' WHEN 'source_code' THEN 'code_aware' WHEN 'build' THEN 'log' ELSE content_type END AS strategy FROM ct",
    "det_min_ratio": "SELECT c_custkey, round(0.85 + 0.10 * least(1.0, greatest(0.0, c_acctbal / 5000.0)), 6) AS min_ratio FROM customer",
    "det_message_disposition": f"""WITH m AS (SELECT *, max(turn) FILTER (contains(text, '[cache]')) OVER (PARTITION BY conv_id) AS mark, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS rest FROM conversations),
a AS (SELECT conv_id, arg_max(regexp_matches(lower(text), '\\b({"|".join(D.ANALYSIS_WORDS)})\\b'), turn) FILTER (role = 'user') AS ask FROM conversations GROUP BY 1)
SELECT conv_id, turn, CASE WHEN turn <= mark THEN 'frozen' WHEN regexp_matches(role, '(?i)^read.*$') THEN 'excluded_tool' WHEN role IN ('user', 'system') THEN 'protected_role' WHEN length(text) < 200 THEN 'small'
  WHEN {_IND.replace("content", "text")} >= 2 THEN 'error_protected' WHEN regexp_matches(text, 'hash=[0-9a-f]{{12,24}}') THEN 'already_compressed' WHEN rest < 2 THEN 'recent' WHEN coalesce(ask, FALSE) THEN 'analysis' ELSE 'compressible' END AS disposition
FROM m LEFT JOIN a USING (conv_id)""",
    "det_tool_excluded": "SELECT p_partkey, p_name ILIKE 'red %' OR p_name ILIKE '%bolt' OR lower(p_name) = 'small ring' AS excluded FROM part",
    "det_analysis_intent": f"WITH {P.SQL} SELECT pid, regexp_matches(lower(content), '\\b({'|'.join(D.ANALYSIS_WORDS)})\\b') AS intent FROM pay",
    "det_error_strong": f"WITH {P.SQL} SELECT pid, {_IND} >= 2 AS strong FROM pay",
    "det_error_any": f"WITH {P.SQL} SELECT pid, {_IND} >= 1 AS found FROM pay",
    "det_line_score": f"""WITH {P.SQL}, l AS (SELECT pid, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no FROM pay WHERE kind IN ('log', 'code', 'text')),
h AS (SELECT *, lower(regexp_extract(line, {_q(_UNI)}, 1)) AS hit FROM l),
c AS (SELECT pid, line_no, CASE WHEN hit IN {_ERRS} THEN 'error' WHEN hit != '' THEN 'importance' WHEN regexp_matches(line, {_q(T.word_pattern(T.WARNING_WORDS))}) THEN 'warning' WHEN {_MD} THEN 'markdown' END AS category FROM h)
SELECT pid, line_no, category, (CASE category WHEN 'error' THEN 0.95 WHEN 'warning' THEN 0.75 WHEN 'importance' THEN 0.6 ELSE 0.45 END)::DOUBLE AS priority, 0.7::DOUBLE AS confidence FROM c WHERE category IS NOT NULL""",
    "det_secret": f"""WITH r AS (SELECT doc_id, text, unnest(list_concat(regexp_extract_all(text, '[0-9a-fA-F]{{32,}}'), ['-'])) AS r, 'h' AS k FROM documents UNION ALL SELECT doc_id, text, unnest(list_concat(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{{40,}}'), ['-'])), 'b' FROM documents),
g AS (SELECT doc_id, bool_or(r != '-' AND regexp_matches(r, '[0-9]') AND CASE k WHEN 'h' THEN regexp_matches(r, '[a-fA-F]') ELSE regexp_matches(r, '[a-z]') AND regexp_matches(r, '[A-Z]') END AND bits >= CASE k WHEN 'h' THEN 3.0 ELSE 4.0 END) AS e FROM (SELECT *, {_BITS.format("r")} AS bits FROM r) GROUP BY 1)
SELECT d.doc_id, regexp_matches(d.text, '-----BEGIN |(^|[^A-Za-z0-9])AKIA[A-Z0-9]{{16}}|(^|[^A-Za-z0-9])(gh[pousr]_|github_pat_)[A-Za-z0-9_]{{20}}|(^|[^A-Za-z0-9])sk-[A-Za-z0-9_-]{{20}}|(^|[^A-Za-z0-9])eyJ[A-Za-z0-9_-]{{5,}}\\.[A-Za-z0-9_-]{{8,}}\\.[A-Za-z0-9_-]{{8}}') AS prefixed, e AS entropy
FROM documents d LEFT JOIN g USING (doc_id)""",
    "det_volatile": r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS token, generate_subscripts(regexp_split_to_array(text, '\s+'), 1) - 1 AS pos FROM documents),
k AS (SELECT *, CASE WHEN regexp_matches(token, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') THEN 'uuid' WHEN regexp_matches(token, '^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$') THEN 'jwt'
  WHEN regexp_matches(token, '^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?.*)?$') THEN 'iso8601' WHEN regexp_matches(token, '^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$') THEN 'hex' END AS kind FROM w)
SELECT doc_id, pos, token, kind FROM k WHERE kind IS NOT NULL""",
    "src_html_sniff": """WITH t AS (SELECT page_id AS id, 'page' AS src, html AS t FROM pages UNION ALL SELECT doc_id, 'doc', text FROM documents)
SELECT id, src, starts_with(lower(left(ltrim(t), 256)), '<!doctype html') OR starts_with(lower(left(ltrim(t), 256)), '<html') OR (contains(lower(t), '</') AND """
    + " + ".join(f"contains(lower(t), '{s}')::INT" for s in D.HTML_SIGNALS)
    + " >= 2) AS is_html FROM t",
}
