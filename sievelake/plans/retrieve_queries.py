"""Queries over retrieval, relevance and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.collections import table
from sievelake.functions import text as T
from sievelake.operators import relevance as V
from sievelake.operators import retrieve as R
from sievelake.plans import payloads as P
from sievelake.plans.store_rows import SQL as STORE_SQL
from sievelake.plans.store_rows import NOW, entries, marked_messages

QUERY = "licensed under the apache license ouing anthat 47113"
NEEDLE = "the apache"


def events(spark, sf):
    return table(spark, sf, "events").withColumn("ord", F.col("event_id")).withColumn("flag", F.col("value") > 50)


def docs(spark, sf):
    return table(spark, sf, "documents")


def _r(c, n=6):
    return F.round(c, n)


def q_by_hash(spark, sf):
    e = entries(spark, sf)
    return e.where((F.col("hash_key") == F.substring(F.sha2(F.lit("doc-7"), 256), 1, 24)) & (F.col("created_at") + F.col("ttl") >= NOW)).select("hash_key", "doc_id", "original_content")


SPECS = [
    {"limit": 0}, {"limit": 5}, {"line_range": [3, 2]}, {"line_range": [1, 2]}, {"context": 51}, {"pattern": "(a+)+b"}, {"pattern": "ERROR.*"}, {"fields": ["a"], "nope": 1}, {"ranges": [("x", None, None)]}, {"limit": True},
]


def q_parse(spark, sf):
    rows = [(i, R.parse_spec(s)[1]) for i, s in enumerate(SPECS)]
    return spark.createDataFrame(rows, "id int, error string")


def q_select_eq(spark, sf):
    return R.select_equals(events(spark, sf), "event_type", "error").select("event_id", "user_id")


def q_select_range(spark, sf):
    return R.select_range(events(spark, sf), "value", 20.0, 60.5).select("event_id", _r("value", 2).alias("value"))


def q_project(spark, sf):
    return R.project(events(spark, sf), ("event_type", "missing", "event_id"))


def q_limit(spark, sf):
    spec, _ = R.parse_spec({"equals": [("event_type", "click")], "limit": 25})
    view, counts = R.apply_spec(events(spark, sf), spec)
    return view.select("event_id").crossJoin(F.broadcast(counts))  # one row


def q_raw_span(spark, sf):
    return R.raw_spans(P.jsons(spark, sf), "pid", "content").withColumnRenamed("start", "first").withColumnRenamed("end", "past")


def q_absent(spark, sf):
    e = events(spark, sf)
    return spark.createDataFrame([(R.absent_fields(e, ("value", "nothing", "zip")),)], "note string")


def q_line_range(spark, sf):
    return R.line_range(docs(spark, sf), "doc_id", "text", 2, 4).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


def q_pattern(spark, sf):
    return R.pattern_context(docs(spark, sf), "doc_id", "text", "(?i)licen[sc]e", 1).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line", "is_match")


PATTERNS = ["ERROR.*", "(a+)+", "[", "x" * 600, r"^\d+$", "(a|b)*", "(ab*)*c"]


def q_screen(spark, sf):
    return spark.createDataFrame([(i, R.screen_pattern(p)) for i, p in enumerate(PATTERNS)], "id int, reason string")


def q_resolve(spark, sf):
    return R.resolve_markers(marked_messages(spark, sf), "doc_id", "text", entries(spark, sf))


def q_marker_scan(spark, sf):
    return R.marker_scan(marked_messages(spark, sf), "doc_id", "text").select("doc_id", F.col("idx").cast("bigint").alias("idx"), "hash")


def q_partition(spark, sf):
    return R.partition_lines(P.logs(spark, sf), "pid", "content", None, "ERROR").select("pid", F.col("run").cast("bigint").alias("run"), "eligible", F.col("first_line").cast("bigint").alias("first_line"), F.col("last_line").cast("bigint").alias("last_line"))


def q_exists(spark, sf):
    e = entries(spark, sf).select("hash_key", (F.col("created_at") + F.col("ttl") >= NOW).alias("live"))
    ask = docs(spark, sf).select(F.col("doc_id"), F.substring(F.sha2(F.concat(F.lit("doc-"), (F.col("doc_id") * 3).cast("string")), 256), 1, 24).alias("hash_key"))
    return ask.join(e, "hash_key", "left").select("doc_id", F.coalesce("live", F.lit(False)).alias("found"))


def q_status(spark, sf):
    e = entries(spark, sf).select("hash_key", (F.col("created_at") + F.col("ttl") >= NOW).alias("live"))
    ask = docs(spark, sf).select(F.col("doc_id"), F.substring(F.sha2(F.concat(F.lit("doc-"), (F.col("doc_id") * 3).cast("string")), 256), 1, 24).alias("hash_key"))
    return ask.join(e, "hash_key", "left").select("doc_id", F.when(F.col("live").isNull(), "unknown").when(F.col("live"), "available").otherwise("expired").alias("status"))


def q_metadata(spark, sf):
    return entries(spark, sf).where(F.col("created_at") + F.col("ttl") >= NOW).select("hash_key", "tool_name", "original_tokens", "compressed_tokens", "compression_strategy")


def q_list_page(spark, sf):
    e = entries(spark, sf)
    age = NOW - F.col("created_at")
    return e.orderBy(F.desc("created_at"), "hash_key").offset(20).limit(20).select("hash_key", T.age_text(age).alias("age"), (F.col("created_at") + F.col("ttl") < NOW).alias("expired"))


def q_tokenize(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"), F.array_join(F.slice(T.tokens(F.col("text")), 1, 20), " ").alias("head"))


def q_bm25_const(spark, sf):
    return V.bm25_const(docs(spark, sf).select("doc_id", "text"), "text", QUERY).select("doc_id", _r("bm25").alias("score"), "matched")


def q_bm25_corpus(spark, sf):
    return V.bm25_corpus(docs(spark, sf).select("doc_id", "text"), "text", QUERY).select("doc_id", _r("bm25").alias("score"), "matched")


def q_hybrid(spark, sf):
    return V.bm25_const(docs(spark, sf).select("doc_id", "text"), "text", QUERY).select("doc_id", _r(V.hybrid(F.col("bm25"), F.col("matched"))).alias("score"))


def q_within(spark, sf):
    items = R.text_lines(docs(spark, sf), "doc_id", "text")
    return V.search_within(items, "doc_id", "line_no", "line", QUERY).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), _r("score").alias("score"), "rank")


def q_all(spark, sf):
    return V.search_all(docs(spark, sf), "doc_id", "text", QUERY).select("doc_id", _r("score").alias("score"))


def q_items_json(spark, sf):
    return V.items_json(P.envelopes(spark, sf), "pid", "content")


def q_items_text(spark, sf):
    w = V.items_words(docs(spark, sf).where("text not like '%\n%'"), "doc_id", "text").select("doc_id", F.lit("words").alias("unit"), F.col("chunk").cast("bigint").alias("chunk"), F.col("word_start").cast("bigint").alias("first"), F.col("word_end").cast("bigint").alias("last"))
    n = V.items_lines(docs(spark, sf).where("text like '%\n%'"), "doc_id", "text").select("doc_id", F.lit("lines"), F.col("chunk").cast("bigint"), F.col("line_start").cast("bigint"), F.col("line_end").cast("bigint"))
    return w.union(n)


def q_numeric_loss(spark, sf):
    e = events(spark, sf)
    t = F.concat(F.lit('{"a": '), F.when(F.col("event_id") % 3 == 0, "123456789012345678901").otherwise(F.col("event_id").cast("string")), F.lit("}"))
    return e.select("event_id", V.numeric_loss(t).alias("loss"))


def q_substring(spark, sf):
    return V.substring_search(docs(spark, sf), "doc_id", "text", "n_chars", NEEDLE, 15).select("doc_id", "n_chars")


def q_preview(spark, sf):
    return docs(spark, sf).select("doc_id", V.preview(F.col("text"), NEEDLE).alias("preview"))


QUERIES = {
    "ret_by_hash": q_by_hash, "ret_parse": q_parse, "ret_select_eq": q_select_eq, "ret_select_range": q_select_range, "ret_project": q_project, "ret_limit": q_limit,
    "ret_raw_span": q_raw_span, "ret_absent_field": q_absent, "ret_line_range": q_line_range, "ret_pattern_context": q_pattern, "ret_regex_screen": q_screen,
    "ret_resolve_markers": q_resolve, "join_markers": q_resolve, "ret_marker_scan": q_marker_scan, "ret_partition_lines": q_partition, "ret_exists": q_exists,
    "ret_status": q_status, "ret_metadata": q_metadata, "ret_list_page": q_list_page, "rel_tokenize": q_tokenize, "rel_bm25_const": q_bm25_const,
    "rel_bm25_corpus": q_bm25_corpus, "join_query_terms": q_bm25_corpus, "rel_hybrid": q_hybrid, "srch_within": q_within, "srch_all": q_all, "srch_items_json": q_items_json,
    "srch_items_text": q_items_text, "srch_numeric_loss": q_numeric_loss, "srch_substring": q_substring, "srch_preview": q_preview,
}



def _tok(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '{T.TOKEN}')"


_TERMS = V.query_terms(QUERY)
_QT = "(VALUES " + ", ".join(f"('{t}', {q})" for t, q in _TERMS.items()) + ") AS q(t, q)"


def _bm25(src: str, key: str, text: str, idf: str, ratio: str, group: str | None = None) -> str:
    """Scores by joining exploded tokens with the query's terms."""
    by = f"PARTITION BY {group}" if group else ""
    keys = f"{group}, {key}" if group else key
    g = f"d.{group}," if group else ""
    return f"""d AS (SELECT {keys}, {_tok(text)} AS tk FROM {src}),
ln AS (SELECT {keys}, coalesce(len(tk), 0) AS n, avg(coalesce(len(tk), 0)) OVER ({by}) AS av, count(*) OVER ({by}) AS docs FROM d),
tf AS (SELECT {keys}, t, q, count(*)::DOUBLE AS f FROM (SELECT {keys}, unnest(tk) AS t FROM d) JOIN {_QT} USING (t) GROUP BY ALL),
df AS (SELECT {group + "," if group else ""} t, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT {keys}, sum({idf} * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * {ratio})) * q) AS s, count(*) AS k, max(length(t)) AS lt FROM tf JOIN ln USING ({keys}) JOIN df USING ({group + "," if group else ""} t) GROUP BY ALL),
sc AS (SELECT {keys}, CASE WHEN coalesce(lt, 0) >= 8 THEN least(1.0, least(1.0, coalesce(s, 0) / 10) + 0.3) ELSE least(1.0, coalesce(s, 0) / 10) END AS score, coalesce(k, 0)::INT AS matched FROM ln LEFT JOIN raw USING ({keys}))"""


_CONST = _bm25("documents", "doc_id", "text", "ln(2.0)", "n / av")
_CORPUS = _bm25("documents", "doc_id", "text", "ln((docs - df + 0.5) / (df + 0.5) + 1.0)", "n / av")
_LINES = "tl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"
_ANY = "'" + R.ANY_MARKER.replace("'", "''") + "'"
_HASH7 = "substr(sha256('doc-7'), 1, 24)"

ORACLES = {
    "ret_by_hash": f"WITH {STORE_SQL} SELECT hash_key, doc_id, original_content FROM store WHERE hash_key = {_HASH7} AND created_at + ttl >= {NOW}",
    "ret_parse": "SELECT * FROM (VALUES (0, 'limit must be a positive integer'), (1, NULL), (2, 'line_range must be [first, last] with 1 <= first <= last'), (3, NULL), (4, 'context must be 0 to 50'), (5, 'pattern refused: nested_quantifier'), (6, NULL), (7, 'unknown parameter nope'), (8, 'range of x has no bound'), (9, 'limit must be a positive integer')) AS t(id, error)",
    "ret_select_eq": "SELECT event_id, user_id FROM events WHERE event_type = 'error'",
    "ret_select_range": "SELECT event_id, round(value, 2) AS value FROM events WHERE value BETWEEN 20.0 AND 60.5",
    "ret_project": "SELECT event_type, event_id FROM events",
    "ret_limit": "WITH m AS (SELECT event_id FROM events WHERE event_type = 'click'), n AS (SELECT count(*) AS matched, least(count(*), 25) AS returned FROM m) SELECT * FROM (SELECT event_id FROM m ORDER BY 1 LIMIT 25), n",
    "ret_raw_span": r"""WITH i AS (SELECT c_nationkey, c_custkey, '{"id": ' || c_custkey || ', "name": "' || c_name || '", "seg": "' || c_mktsegment || '"}' AS raw FROM customer)
SELECT 'json-' || c_nationkey AS pid, row_number() OVER w - 1 AS idx, CAST(1 + coalesce(sum(length(raw) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first,
  CAST(1 + coalesce(sum(length(raw) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(raw) AS BIGINT) AS past, raw FROM i WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)""",
    "ret_absent_field": "SELECT 'unknown: nothing, zip; known: event_id, event_type, flag, ord, props, ts, user_id, value' AS note",
    "ret_line_range": f"WITH {_LINES} SELECT doc_id, line_no, line FROM tl WHERE line_no BETWEEN 2 AND 4",
    "ret_pattern_context": f"WITH {_LINES}, m AS (SELECT *, regexp_matches(line, '(?i)licen[sc]e') AS is_match FROM tl) SELECT doc_id, line_no, line, is_match FROM m a WHERE EXISTS (SELECT 1 FROM m b WHERE b.doc_id = a.doc_id AND b.line_no BETWEEN a.line_no - 1 AND a.line_no + 1 AND b.is_match)",
    "ret_regex_screen": "SELECT * FROM (VALUES (0, NULL), (1, 'nested_quantifier'), (2, 'invalid'), (3, 'too_long'), (4, NULL), (5, NULL), (6, 'nested_quantifier')) AS t(id, reason)",
    "ret_resolve_markers": f"""WITH {STORE_SQL}, msg AS (SELECT d.doc_id, d.doc_id * 2 AS other, d.doc_id % 3 AS k, 'see [9 rows compressed to 0. Retrieve more: hash=' || substr(sha256('doc-' || d.doc_id * 2), 1, 24) || '] or <<ccr:' || substr(sha256('doc-' || d.doc_id), 1, 24) || ' 7_rows>> end' AS full FROM documents d)
SELECT m.doc_id, CASE k WHEN 0 THEN 'plain text' WHEN 1 THEN 'see ' || coalesce(a.original_content, '[9 rows compressed to 0. Retrieve more: hash=' || substr(sha256('doc-' || m.other), 1, 24) || ']') || ' or ' || coalesce(b.original_content, '<<ccr:' || substr(sha256('doc-' || m.doc_id), 1, 24) || ' 7_rows>>') || ' end' END AS text
FROM msg m LEFT JOIN store a ON a.doc_id = m.other LEFT JOIN store b ON b.doc_id = m.doc_id""",
    "ret_marker_scan": "SELECT doc_id, unnest([0, 1])::BIGINT AS idx, unnest([substr(sha256('doc-' || doc_id * 2), 1, 24), substr(sha256('doc-' || doc_id), 1, 24)]) AS hash FROM documents WHERE doc_id % 3 = 1",
    "ret_partition_lines": f"""WITH {P.SQL}, l AS (SELECT 'log-' || user_id AS pid, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no, NOT contains(l, 'ERROR') AS eligible FROM lg),
r AS (SELECT *, sum(new) OVER (PARTITION BY pid ORDER BY line_no) AS run FROM (SELECT *, coalesce((eligible != lag(eligible) OVER (PARTITION BY pid ORDER BY line_no))::INT, 0) AS new FROM l))
SELECT pid, run::BIGINT AS run, eligible, min(line_no) AS first_line, max(line_no) AS last_line FROM r GROUP BY 1, 2, 3""",
    "ret_exists": f"WITH {STORE_SQL} SELECT d.doc_id, coalesce(s.created_at + s.ttl >= {NOW}, FALSE) AS found FROM documents d LEFT JOIN store s ON s.doc_id = d.doc_id * 3",
    "ret_status": f"WITH {STORE_SQL} SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN 'unknown' WHEN s.created_at + s.ttl >= {NOW} THEN 'available' ELSE 'expired' END AS status FROM documents d LEFT JOIN store s ON s.doc_id = d.doc_id * 3",
    "ret_metadata": f"WITH {STORE_SQL} SELECT hash_key, tool_name, original_tokens, compressed_tokens, compression_strategy FROM store WHERE created_at + ttl >= {NOW}",
    "ret_list_page": f"""WITH {STORE_SQL}, a AS (SELECT *, ({NOW} - created_at)::BIGINT AS age_s FROM store) SELECT hash_key, CASE WHEN age_s < 60 THEN age_s || 's ago' WHEN age_s < 3600 THEN age_s // 60 || 'm ago' WHEN age_s < 86400 THEN age_s // 3600 || 'h ago' ELSE age_s // 86400 || 'd ago' END AS age,
  created_at + ttl < {NOW} AS expired FROM a ORDER BY created_at DESC, hash_key LIMIT 20 OFFSET 20""",
    "rel_tokenize": f"WITH t AS (SELECT doc_id, {_tok('text')} AS tk FROM documents) SELECT doc_id, len(tk)::INT AS n, array_to_string(list_slice(tk, 1, 20), ' ') AS head FROM t",
    "rel_bm25_const": f"WITH {_CONST} SELECT doc_id, round(score, 6) AS score, matched FROM sc",
    "rel_bm25_corpus": f"WITH {_CORPUS} SELECT doc_id, round(score, 6) AS score, matched FROM sc",
    "rel_hybrid": f"WITH {_CONST} SELECT doc_id, round(CASE WHEN matched = 0 THEN score WHEN matched = 1 THEN greatest(score, 0.3) ELSE least(1.0, greatest(score, 0.3) + 0.2) END, 6) AS score FROM sc",
    "srch_within": f"WITH {_LINES}, " + _bm25("tl", "line_no", "line", "ln((docs - df + 0.5) / (df + 0.5) + 1.0)", "n / av", "doc_id") + ", rk AS (SELECT doc_id, line_no, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS rank FROM sc WHERE score >= 0.3) SELECT doc_id, line_no, round(score, 6) AS score, rank::INT AS rank FROM rk WHERE rank <= 20",
    "srch_all": f"WITH {_CORPUS} SELECT doc_id, round(score, 6) AS score FROM sc WHERE score > 0 ORDER BY sc.score DESC, doc_id LIMIT 10",
    "srch_items_json": """WITH s AS (SELECT 'envelope-' || s_nationkey AS pid, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, s_suppkey, s_name FROM supplier)
SELECT pid, 'data[' || i || '].id' AS path, s_suppkey::VARCHAR AS value FROM s UNION ALL SELECT pid, 'data[' || i || '].name', '"' || s_name || '"' FROM s UNION ALL SELECT DISTINCT pid, 'meta.page', '1' FROM s""",
    "srch_items_text": r"""WITH RECURSIVE w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x != '')) AS n FROM documents WHERE text NOT LIKE '%' || chr(10) || '%'),
ws AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 350 THEN 1 ELSE ceil((n - 350) / 300)::BIGINT + 1 END)) AS chunk FROM w WHERE n > 0),
l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x) + 1) AS sz FROM documents WHERE text LIKE '%' || chr(10) || '%' AND trim(text) != ''),
g AS (SELECT doc_id, sz, 1 AS i, sz[1] AS used, 0 AS chunk FROM l UNION ALL SELECT doc_id, sz, i + 1, CASE WHEN used + sz[i + 1] > 2000 THEN sz[i + 1] ELSE used + sz[i + 1] END, CASE WHEN used + sz[i + 1] > 2000 THEN chunk + 1 ELSE chunk END FROM g WHERE i < len(sz))
SELECT doc_id, 'words' AS unit, chunk, chunk * 300 + 1 AS first, least(chunk * 300 + 350, n) AS last FROM ws UNION ALL SELECT doc_id, 'lines', chunk::BIGINT, min(i)::BIGINT, max(i)::BIGINT FROM g GROUP BY doc_id, chunk""",
    "srch_numeric_loss": "WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '123456789012345678901' ELSE event_id::VARCHAR END AS n FROM events) SELECT event_id, n::HUGEINT != n::DOUBLE::HUGEINT AS loss FROM t",
    "srch_substring": f"SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), '{NEEDLE}') ORDER BY n_chars DESC, doc_id LIMIT 15",
    "srch_preview": f"""WITH p AS (SELECT doc_id, text, instr(lower(text), '{NEEDLE}') AS hit FROM documents), q AS (SELECT *, greatest(hit - 40, 1) AS lo FROM p)
SELECT doc_id, CASE WHEN hit > 0 THEN CASE WHEN lo > 1 THEN '...' ELSE '' END || substr(text, lo, {len(NEEDLE) + 80}) || CASE WHEN lo + {len(NEEDLE) + 79} < length(text) THEN '...' ELSE '' END ELSE substr(text, 1, 80) END AS preview FROM q""",
}
ORACLES["join_markers"] = ORACLES["ret_resolve_markers"]
ORACLES["join_query_terms"] = ORACLES["rel_bm25_corpus"]
