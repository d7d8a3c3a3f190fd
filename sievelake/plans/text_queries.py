"""Queries over logs, search results, diffs, prose, mixed text and code."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.collections import table
from sievelake.functions import text as T
from sievelake.operators import code as C
from sievelake.operators import logs as L
from sievelake.operators import prose as R
from sievelake.operators.reduce import per_document
from sievelake.plans import payloads as P
from sievelake.shared import written

QUERY = "purchase timeout user"


def _long(df):
    return df.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def raw_lines(spark, sf):
    return P.logs(spark, sf).select("pid", F.posexplode(T.lines(F.col("content"))).alias("line_no", "line"))


def traced(spark, sf):
    """Logs whose errors are followed by a Python trace."""
    fixed = "\nTraceback (most recent call last):\n  File \"/srv/app.py\", line 10\n    run()\nValueError: bad input"
    return P.logs(spark, sf).select("pid", F.regexp_replace("content", r"(?m)^(.* ERROR .*)$", "$1" + fixed.replace("$", "\\$")).alias("content"))


def log_rows(spark, sf):
    return L.log_lines(traced(spark, sf), "pid", "content")


def q_log_lines(spark, sf):
    return _long(log_rows(spark, sf))


def q_log_trace(spark, sf):
    return _long(log_rows(spark, sf).groupBy("pid").agg(F.sum(F.col("is_trace").cast("int")).alias("trace_lines"), F.sum((F.col("level") == "error").cast("int")).alias("errors")))


def q_log_format(spark, sf):
    return P.payloads(spark, sf).select("pid", L.log_format(F.col("content")).alias("format"))


def q_log_level(spark, sf):
    return raw_lines(spark, sf).select("pid", F.col("line_no").cast("bigint").alias("line_no"), L.log_level(F.col("line")).alias("level"))


def q_summary_line(spark, sf):
    mixed = table(spark, sf, "orders").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 4 == 0, F.concat((F.col("o_orderkey") % 9).cast("string"), F.lit(" passed in "))).when(F.col("o_orderkey") % 4 == 1, "Tests: ").when(F.col("o_orderkey") % 4 == 2, "Build step ").otherwise("=== "), F.when(F.col("o_orderkey") % 8 < 4, "3 complete").otherwise("x")).alias("line"))
    return mixed.select("o_orderkey", L.is_summary(F.col("line")).alias("is_summary"))


def q_log_score(spark, sf):
    return _long(log_rows(spark, sf).select("pid", "line_no", "score"))


def q_log_dedup(spark, sf):
    r = raw_lines(spark, sf).select("pid", "line_no", L.dedup_key(F.col("line")).alias("dedup_key"))
    return _long(r.groupBy("pid", "dedup_key").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n")))


def q_template_count(spark, sf):
    return raw_lines(spark, sf).groupBy(L.template(F.col("line")).alias("template")).agg(F.count("*").alias("n"))


def q_strip_identity(spark, sf):
    return _long(raw_lines(spark, sf).select("pid", "line_no", L.strip_identity(F.col("line")).alias("line")))


def q_first_last(spark, sf):
    r = raw_lines(spark, sf).withColumn("score", L.log_score(L.log_level(F.col("line")), F.lit(False), F.lit(False)))
    return _long(L.first_last(r, "pid", 6).select("pid", "line_no"))


def q_log_select(spark, sf):
    # Written once: the trace machine is Python, and the selection reads its rows for every rule.
    return _long(L.select_lines(written(log_rows(spark, sf)), "pid").select("pid", "line_no", F.array_join("reasons", ",").alias("reasons")))


def q_log_template(spark, sf):
    return L.log_templates(P.logs(spark, sf), "pid", "content")


def greps(spark, sf):
    """Search results per user: lines of their events as matches."""
    line = F.concat(F.lit("src/"), F.col("event_type"), F.lit(".py:"), (F.col("event_id") % 300).cast("string"), F.lit(":"), P.log_line())
    return P._joined(table(spark, sf, "events"), "hits", "user_id", "event_id", line, "\n")


def matches(spark, sf):
    return R.grep_matches(greps(spark, sf), "pid", "content")


def q_src_grep(spark, sf):
    return _long(matches(spark, sf))


def q_grep_score(spark, sf):
    return _long(matches(spark, sf).select("pid", "pos", R.grep_score(F.col("content"), QUERY, ("cents 1",)).alias("score")))


def q_grep_select(spark, sf):
    return _long(R.grep_select(matches(spark, sf), "pid", QUERY).select("pid", "file", "line_no", "content"))


def q_grep_render(spark, sf):
    m = matches(spark, sf).dropDuplicates(["pid", "file", "line_no", "content"])
    return R.grep_render(R.grep_select(m, "pid", QUERY), m, "pid")


def diff_rows(spark, sf):
    return R.diff_lines(P.diffs(spark, sf), "pid", "content")


def q_src_diff(spark, sf):
    return _long(diff_rows(spark, sf))


def hunks(spark, sf):
    return R.diff_hunks(diff_rows(spark, sf), "pid", "the ouing")


def q_diff_score(spark, sf):
    return _long(hunks(spark, sf).select("pid", "file_no", "hunk_no", "adds", "dels", "score"))


def q_diff_noise(spark, sf):
    return _long(hunks(spark, sf).select("pid", "file_no", "hunk_no", "whitespace_only", "lockfile"))


def q_diff_select(spark, sf):
    return _long(R.diff_select(hunks(spark, sf), "pid", per_file=3))


def q_diff_context(spark, sf):
    return _long(R.diff_context(diff_rows(spark, sf), "pid").select("pid", "pos", "kind"))


def segs(spark, sf):
    return R.text_segments(table(spark, sf, "documents"), "doc_id", "text")


def q_segments(spark, sf):
    return segs(spark, sf).select("doc_id", "idx", "kind", F.length("segment").alias("chars"))


def q_text_score(spark, sf):
    return R.text_score(segs(spark, sf), "doc_id", "license the ouing").select("doc_id", "idx", F.round("score", 6).alias("score"))


def q_text_mandatory(spark, sf):
    s = segs(spark, sf)
    return s.where(R.text_mandatory(s)).select("doc_id", "idx")


def q_text_dedup(spark, sf):
    return R.text_dedup(written(segs(spark, sf)), "doc_id")


def q_text_select(spark, sf):
    s = written(segs(spark, sf))
    return R.text_select(R.text_score(s, "doc_id"), R.text_dedup(s, "doc_id"), "doc_id")


def q_mixed_predicate(spark, sf):
    return P.payloads(spark, sf).select("pid", R.is_mixed(F.col("content")).alias("mixed"))


def q_mixed_split(spark, sf):
    d = P.payloads(spark, sf).where("kind in ('log', 'json', 'code')")
    parts = per_document(d, "pid", "content", lambda t: ([{"kind": k, "chars": len(x)} for k, x in R.sections(t)],), "parts array<struct<kind:string,chars:bigint>>")
    return parts.select("pid", F.posexplode("parts").alias("i", "p")).select("pid", F.col("i").cast("bigint").alias("i"), "p.kind", "p.chars")


def q_tags(spark, sf):
    wrapped = table(spark, sf, "conversations").where("text is not null").select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("id"), F.concat(F.lit("<tool-use id=\"1\">"), F.substring("text", 1, 30), F.lit("</tool-use> and <b>"), F.expr("substring(text, 31)"), F.lit("</b>")).alias("t"))

    def run(t):
        clean, blocks = R.protect_tags(t)
        return len(blocks), R.restore_tags(clean, blocks) == t, len(clean)

    return per_document(wrapped, "id", "t", run, "blocks int, restored boolean, clean_chars int")


def codes(spark, sf):
    return P.codes(spark, sf)


def q_code_lang(spark, sf):
    return per_document(P.payloads(spark, sf).where("kind in ('code', 'log', 'csv')"), "pid", "content", lambda t: (C.language(t),), "language string")


def q_code_importance(spark, sf):
    u = C.unit_rows(codes(spark, sf), "pid", "content", "size 4")
    return u.select("pid", "name", F.round("score", 6).alias("score"), "lines")


def q_code_budget(spark, sf):
    return C.budgets(q_code_importance(spark, sf), "pid", "score", "lines").select("pid", "name", F.round("budget", 6).alias("budget"))


def q_code_truncate(spark, sf):
    return per_document(codes(spark, sf), "pid", "content", lambda t: C.truncate(t), "view string, valid boolean")


QUERIES = {
    "src_log_lines": q_log_lines, "log_trace": q_log_trace, "log_format": q_log_format, "log_level": q_log_level, "log_summary_line": q_summary_line, "log_score": q_log_score,
    "log_select": q_log_select, "log_first_last": q_first_last, "log_dedup": q_log_dedup, "log_template_count": q_template_count, "log_strip_identity": q_strip_identity,
    "enc_log_template": q_log_template, "src_grep": q_src_grep, "grep_score": q_grep_score, "grep_select": q_grep_select, "grep_render": q_grep_render, "src_diff": q_src_diff,
    "diff_score": q_diff_score, "diff_noise": q_diff_noise, "diff_select": q_diff_select, "diff_context": q_diff_context, "src_text_segments": q_segments, "text_score": q_text_score,
    "text_mandatory": q_text_mandatory, "text_dedup": q_text_dedup, "text_select": q_text_select, "det_mixed": q_mixed_predicate, "src_mixed_split": q_mixed_split, "text_tags": q_tags,
    "code_lang": q_code_lang, "code_importance": q_code_importance, "code_budget": q_code_budget, "code_truncate": q_code_truncate,
}

# ---- oracle ---------------------------------------------------------------

_ERRLINE = "contains(l, ' ERROR ')"
_LG = f"""WITH {P.SQL}, lx AS (SELECT 'log-' || user_id AS pid, user_id, event_id, l, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM lg)"""
_TR = (
    _LG
    + f""", te AS (SELECT pid, rn, unnest(CASE WHEN {_ERRLINE} THEN [l, 'Traceback (most recent call last):', '  File "/srv/app.py", line 10', '    run()', 'ValueError: bad input'] ELSE [l] END) AS line, unnest(CASE WHEN {_ERRLINE} THEN [0, 1, 2, 3, 4] ELSE [0] END) AS k FROM lx),
tl AS (SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY rn, k) - 1 AS line_no, line, k > 0 AS is_trace FROM te)"""
)
_RE2LEVEL = L.LEVEL.replace("'", "''")
_LEVELCASE = "CASE " + " ".join("WHEN hit IN (" + ", ".join(f"'{w}'" for w in ws) + f") THEN '{n}'" for n, ws in L.LEVEL_WORDS) + " ELSE 'unknown' END"
_SC = "CASE level WHEN 'error' THEN 1.0 WHEN 'fail' THEN 1.0 WHEN 'warn' THEN 0.5 WHEN 'debug' THEN 0.05 WHEN 'trace' THEN 0.02 ELSE 0.1 END"
_TL2 = _TR + f""", lv AS (SELECT *, {_LEVELCASE} AS level, regexp_matches(line, '{L.SUMMARY}') AS is_summary FROM (SELECT *, regexp_extract(line, '{_RE2LEVEL}', 1) AS hit FROM tl)),
sc AS (SELECT pid, line_no, line, is_trace, level, is_summary, least(1.0, {_SC} + CASE WHEN is_trace THEN 0.3 ELSE 0 END + CASE WHEN is_summary THEN 0.4 ELSE 0 END)::DOUBLE AS score FROM lv)"""
_ID = "'" + L.IDENTITY + "'"


def _mask(e: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({e}, '0x[0-9a-fA-F]+', 'ADDR', 'g'), '[0-9]+', 'N', 'g'), '/[A-Za-z0-9_./-]+/', '/PATH/', 'g')"


_KEYS = f", kx AS (SELECT *, regexp_replace(l, {_ID}, '<TS> ') AS b FROM lx), ky AS (SELECT *, regexp_extract(b, '^([^:=]*)', 1) AS hd FROM kx)"
_GM = _LG + """, gm AS (SELECT 'hits-' || user_id AS pid, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, 'src/' || event_type || '.py' AS file, event_id % 300 AS line_no, ':' AS sep, l AS content FROM lx JOIN (SELECT event_id, event_type FROM events) USING (event_id))"""
_GWORDS = " + ".join(f"contains(lower(content), '{w}')::INT * 0.3" for w in QUERY.split())
_UNI = T.word_pattern(T.ERROR_WORDS + T.IMPORTANCE_WORDS)
_CAT = f"CASE WHEN lower(regexp_extract(content, '{_UNI}', 1)) IN ({', '.join(repr(w) for w in T.ERROR_WORDS)}) THEN 0.5 WHEN regexp_extract(content, '{_UNI}', 1) != '' THEN 0.3 WHEN regexp_matches(content, '{T.word_pattern(T.WARNING_WORDS)}') THEN 0.4 ELSE 0 END"
_GS = f"least(1.0, {_GWORDS} + {_CAT})::DOUBLE"
_GSEL = _GM + f""", gd AS (SELECT DISTINCT pid, file, line_no, content FROM gm), gs AS (SELECT *, {_GS} AS score FROM gd),
gf AS (SELECT pid, file, row_number() OVER (PARTITION BY pid ORDER BY round(sum(score), 6) DESC, file) AS fr, count(*) AS n FROM gs GROUP BY 1, 2),
ga AS (SELECT gs.*, fr, gf.n, row_number() OVER (PARTITION BY gs.pid, gs.file ORDER BY line_no, content) AS a, row_number() OVER (PARTITION BY gs.pid, gs.file ORDER BY line_no DESC, content DESC) AS z FROM gs JOIN gf USING (pid, file) WHERE fr <= 15),
gi AS (SELECT *, row_number() OVER (PARTITION BY pid, file ORDER BY CASE WHEN a = 1 THEN 0 WHEN z = 1 THEN 1 ELSE 2 END, score DESC, line_no, content) AS i FROM ga),
gk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY fr, i) AS g FROM gi WHERE i <= 5) WHERE g <= 30)"""
_DL = f"""WITH {P.SQL}, d0 AS (SELECT pid, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS pos FROM diffs),
d1 AS (SELECT *, sum(regexp_matches(line, '{R.FILE_HEADER}')::INT) OVER (PARTITION BY pid ORDER BY pos) AS file_no FROM d0), d2 AS (SELECT *, sum(regexp_matches(line, '{R.HUNK_HEADER}')::INT) OVER (PARTITION BY pid, file_no ORDER BY pos) AS hunk_no FROM d1),
dl AS (SELECT pid, pos, file_no::BIGINT AS file_no, hunk_no::BIGINT AS hunk_no, line, CASE WHEN regexp_matches(line, '{R.FILE_HEADER}') THEN 'file' WHEN regexp_matches(line, '{R.HUNK_HEADER}') THEN 'hunk' WHEN hunk_no = 0 OR regexp_matches(line, '^(--- |\\+\\+\\+ )') THEN 'meta'
  WHEN line LIKE '+%' THEN 'add' WHEN line LIKE '-%' THEN 'del' WHEN line LIKE ' %' OR line = '' THEN 'context' ELSE 'other' END AS kind FROM d2)"""
_HK = _DL + f""", hk AS (SELECT pid, file_no, hunk_no, sum((kind = 'add')::INT)::BIGINT AS adds, sum((kind = 'del')::INT)::BIGINT AS dels, bool_or(kind != 'hunk' AND regexp_matches(line, '{R.PRIORITY}')) AS wt, bool_or(kind IN ('add', 'del') AND trim(substr(line, 2)) != '') AS rl,
  bool_or(kind != 'hunk' AND contains(lower(line), 'the')) AS w0, bool_or(kind != 'hunk' AND contains(lower(line), 'ouing')) AS w1 FROM dl WHERE hunk_no > 0 GROUP BY 1, 2, 3),
hs AS (SELECT *, least(1.0, least(0.3, (adds + dels) * 0.03) + w0::INT * 0.2 + w1::INT * 0.2 + wt::INT * 0.3)::DOUBLE AS score, NOT rl AND adds + dels > 0 AS whitespace_only FROM hk)"""
_MIX = """WITH {P}, m AS (SELECT pid, content, string_split(content, chr(10)) AS ls FROM pay) SELECT pid, (regexp_matches(content, '(?m)^```')::INT + (len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*[\\[{{]'))) > 0)::INT + (len(list_filter(ls, lambda x: regexp_matches(x, '^[^\\s:]+:\\d+:'))) >= 2)::INT
 + (len(list_filter(ls, lambda x: regexp_matches(x, '^[A-Z][^{{}}\\[\\]]{{20,}}[.!?]'))) > 0)::INT >= 2) AND NOT (starts_with(trim(content, ' '), '[') AND json_valid(trim(content, ' '))) AS mixed FROM m"""

ORACLES = {
    "src_log_lines": _TL2 + " SELECT pid, line_no, line, is_trace, level, is_summary, round(score, 6) AS score FROM sc",
    "log_trace": _TL2 + " SELECT pid, sum(is_trace::INT)::BIGINT AS trace_lines, sum((level = 'error')::INT)::BIGINT AS errors FROM sc GROUP BY 1",
    "log_level": _LG + f" SELECT pid, rn AS line_no, {_LEVELCASE} AS level FROM (SELECT *, regexp_extract(l, '{_RE2LEVEL}', 1) AS hit FROM lx)",
    "log_summary_line": f"WITH m AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 9 || ' passed in ' WHEN 1 THEN 'Tests: ' WHEN 2 THEN 'Build step ' ELSE '=== ' END || CASE WHEN o_orderkey % 8 < 4 THEN '3 complete' ELSE 'x' END AS line FROM orders) SELECT o_orderkey, regexp_matches(line, '{L.SUMMARY}') AS is_summary FROM m",
    "log_score": _TL2 + " SELECT pid, line_no, round(score, 6) AS score FROM sc",
    "log_dedup": _LG + _KEYS + f" SELECT pid, hd || {_mask('substr(b, length(hd) + 1)')} AS dedup_key, min(rn) AS first_line, count(*) AS n FROM ky GROUP BY 1, 2",
    "log_template_count": _LG + _KEYS + f" SELECT {_mask('b')} AS template, count(*) AS n FROM kx GROUP BY 1",
    "log_strip_identity": _LG + _KEYS + " SELECT pid, rn AS line_no, b AS line FROM kx",
    "log_first_last": _LG + f""", s AS (SELECT *, {_SC} AS score FROM (SELECT *, {_LEVELCASE} AS level FROM (SELECT *, regexp_extract(l, '{_RE2LEVEL}', 1) AS hit FROM lx))), a AS (SELECT *, min(rn) OVER (PARTITION BY pid) AS lo, max(rn) OVER (PARTITION BY pid) AS hi FROM s)
SELECT pid, rn AS line_no FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY CASE WHEN rn IN (lo, hi) THEN 0 ELSE 1 END, score DESC, rn) AS r FROM a) WHERE r <= 6""",
    "log_select": _TL2 + f""", wn AS (SELECT pid, min(line_no) AS line_no FROM (SELECT *, regexp_replace(line, {_ID}, '<TS> ') AS b FROM sc WHERE level = 'warn') GROUP BY pid, regexp_extract(b, '^([^:=]*)', 1) || {_mask("substr(b, length(regexp_extract(b, '^([^:=]*)', 1)) + 1)")}),
er AS (SELECT pid, line_no FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY CASE WHEN line_no IN (lo, hi) THEN 0 ELSE 1 END, score DESC, line_no) AS r FROM (SELECT *, min(line_no) OVER (PARTITION BY pid) AS lo, max(line_no) OVER (PARTITION BY pid) AS hi FROM sc WHERE level = 'error')) WHERE r <= 10),
rn AS (SELECT *, sum((is_trace AND NOT coalesce(pt, FALSE))::INT) OVER (PARTITION BY pid ORDER BY line_no) AS run FROM (SELECT *, lag(is_trace) OVER (PARTITION BY pid ORDER BY line_no) AS pt FROM sc)),
tp AS (SELECT *, {_mask(f"regexp_replace(line, {_ID}, '<TS> ')")} AS t FROM sc), tc AS (SELECT *, count(*) OVER (PARTITION BY pid, t) AS c FROM tp),
ra AS (SELECT pid, line_no FROM (SELECT pid, min(line_no) AS line_no, row_number() OVER (PARTITION BY pid ORDER BY min(c), min(line_no)) AS r FROM tc WHERE c <= 3 AND level IN ('info', 'unknown', 'debug', 'trace') AND NOT is_trace AND NOT is_summary GROUP BY pid, t) WHERE r <= 10),
pk AS (SELECT pid, line_no, 'error' AS r FROM er UNION SELECT pid, line_no, 'warning' FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY line_no) AS q FROM wn) WHERE q <= 5 UNION SELECT pid, line_no, 'trace' FROM rn WHERE is_trace AND run <= 3 UNION SELECT pid, line_no, 'summary' FROM sc WHERE is_summary UNION SELECT pid, line_no, 'rare' FROM ra),
pg AS (SELECT pid, line_no, string_agg(r, ',' ORDER BY r) AS reasons FROM pk GROUP BY 1, 2),
nr AS (SELECT sc.*, reasons, max((reasons IS NOT NULL)::INT) OVER (PARTITION BY sc.pid ORDER BY sc.line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM sc LEFT JOIN pg USING (pid, line_no))
SELECT pid, line_no, coalesce(reasons, 'context') AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, line_no) AS q FROM nr WHERE near = 1) WHERE q <= 100""",
    "src_grep": _GM + " SELECT * FROM gm",
    "grep_score": _GM + f" SELECT pid, pos, round(least(1.0, {_GWORDS} + {_CAT} + contains(lower(content), 'cents 1')::INT * 0.4)::DOUBLE, 6) AS score FROM gm",
    "grep_select": _GSEL + " SELECT pid, file, line_no, content FROM gk",
    "grep_render": _GSEL + """, bl AS (SELECT pid, file, string_agg(file || ':' || line_no || ':' || content, chr(10) ORDER BY line_no, content) || CASE WHEN max(n) > count(*) THEN chr(10) || '[... and ' || (max(n) - count(*)) || ' more matches in ' || file || ']' ELSE '' END AS t FROM gk GROUP BY 1, 2)
SELECT pid, string_agg(t, chr(10) ORDER BY file) AS text FROM bl GROUP BY 1""",
    "src_diff": _DL + " SELECT * FROM dl",
    "diff_score": _HK + " SELECT pid, file_no, hunk_no, adds, dels, round(score, 6) AS score FROM hs",
    "diff_noise": _HK + " SELECT pid, file_no, hunk_no, whitespace_only, FALSE AS lockfile FROM hs",
    "diff_select": _HK + """, a AS (SELECT *, min(hunk_no) OVER (PARTITION BY pid, file_no) AS lo, max(hunk_no) OVER (PARTITION BY pid, file_no) AS hi FROM hs WHERE NOT whitespace_only)
SELECT pid, file_no, hunk_no FROM (SELECT *, row_number() OVER (PARTITION BY pid, file_no ORDER BY CASE WHEN hunk_no IN (lo, hi) THEN 0 ELSE 1 END, score DESC, hunk_no) AS r FROM a) WHERE r <= 3""",
    "diff_context": _DL + ", n AS (SELECT *, max((kind IN ('add', 'del'))::INT) OVER (PARTITION BY pid, file_no, hunk_no ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS nr FROM dl WHERE hunk_no > 0 AND kind != 'hunk') SELECT pid, pos, kind FROM n WHERE nr = 1 OR starts_with(line, chr(92))",
    "det_mixed": _MIX.replace("{P}", P.SQL).replace("{{", "{").replace("}}", "}"),
    "text_tags": """WITH t AS (SELECT conv_id || '/' || turn AS id, text FROM conversations WHERE text IS NOT NULL) SELECT id, 1::INT AS blocks, TRUE AS restored, (3 + length(' and <b>') + length(substr(text, 31)) + length('</b>'))::INT AS clean_chars FROM t""",
}
