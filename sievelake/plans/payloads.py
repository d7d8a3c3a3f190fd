"""Texts of every type, derived from the tables: (pid, kind, content).

Logs, JSON arrays, envelopes, CSV, diffs and code are built per user, nation,
brand or conversation; search results and prose from documents row by row. The
same is said in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.collections import table

LEVEL = {"error": "ERROR", "signup": "WARN", "click": "INFO", "purchase": "INFO", "view": "DEBUG"}


def _joined(df: DataFrame, kind: str, key: str, order: str, line, sep: str, head=None, tail=None) -> DataFrame:
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), sep)
    parts = [p for p in (head, body, tail) if p is not None]
    g = df.groupBy(key).agg(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("content"))
    return g.select(F.concat(F.lit(f"{kind}-"), F.col(key).cast("string")).alias("pid"), F.lit(kind).alias("kind"), "content")


def log_line():
    level = F.create_map(*[F.lit(x) for kv in LEVEL.items() for x in kv])[F.col("event_type")]
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    return F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), level, F.lit(" user="), F.col("user_id").cast("string"), F.lit(" "), "event_type",
        F.lit(": cents "), cents, F.lit(" at /srv/app"), (F.col("event_id") % 7).cast("string"), F.lit("/run"),
    )


def logs(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(table(spark, sf, "events"), "log", "user_id", "event_id", log_line(), "\n")


def jsons(spark: SparkSession, sf: str) -> DataFrame:
    item = F.concat(F.lit('{"id": '), F.col("c_custkey").cast("string"), F.lit(', "name": "'), "c_name", F.lit('", "seg": "'), "c_mktsegment", F.lit('"}'))
    return _joined(table(spark, sf, "customer"), "json", "c_nationkey", "c_custkey", item, ",", F.lit("["), F.lit("]"))


def envelopes(spark: SparkSession, sf: str) -> DataFrame:
    item = F.concat(F.lit('{"id": '), F.col("s_suppkey").cast("string"), F.lit(', "name": "'), "s_name", F.lit('"}'))
    return _joined(table(spark, sf, "supplier"), "envelope", "s_nationkey", "s_suppkey", item, ",", F.lit('{"data": ['), F.lit('], "meta": {"page": 1}}'))


def csvs(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", "p_type", F.col("p_size").cast("string"))
    return _joined(table(spark, sf, "part"), "csv", "p_brand", "p_partkey", line, "\n", F.lit("key,name,type,size\n"))


def diffs(spark: SparkSession, sf: str) -> DataFrame:
    sign = F.when(F.col("role") == "user", "-").when(F.col("role") == "assistant", "+").otherwise(" ")
    body = F.concat(sign, F.regexp_replace("text", "\n", F.concat(F.lit("\n"), sign)))
    t = F.col("turn").cast("string")
    hunk = F.concat(F.lit("@@ -"), t, F.lit(",3 +"), t, F.lit(",4 @@\n"), body)
    rows = table(spark, sf, "conversations").where("text is not null").withColumn("key", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    name = F.concat(F.lit("diff --git a/"), F.first("key"), F.lit(".txt b/"), F.first("key"), F.lit(".txt\n--- a/"), F.first("key"), F.lit(".txt\n+++ b/"), F.first("key"), F.lit(".txt\n"))
    return _joined(rows, "diff", "key", "turn", hunk, "\n", name)


def greps(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt:"), (i + 1).cast("string"), F.lit(":"), x))
    return d.select(F.concat(F.lit("grep-"), F.col("doc_id").cast("string")).alias("pid"), F.lit("grep").alias("kind"), F.array_join(numbered, "\n").alias("content"))


def codes(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("def part_"), key, F.lit("(size):\n    # "), "p_name", F.lit("\n    return size + "), F.col("p_size").cast("string"), F.lit("\n"))
    return _joined(table(spark, sf, "part"), "code", "p_type", "p_partkey", body, "\n", F.lit("import math\n\n"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.concat(F.lit("text-"), F.col("doc_id").cast("string")).alias("pid"), F.lit("text").alias("kind"), F.col("text").alias("content"))


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    out = logs(spark, sf)
    for f in (jsons, envelopes, csvs, diffs, greps, codes, texts):
        out = out.unionByName(f(spark, sf))
    return out


SQL = r"""
lg AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END || ' user=' || user_id || ' ' || event_type || ': cents ' || round(value * 100)::BIGINT || ' at /srv/app' || event_id % 7 || '/run' AS l FROM events),
logs AS (SELECT 'log-' || user_id AS pid, 'log' AS kind, string_agg(l, chr(10) ORDER BY event_id) AS content FROM lg GROUP BY user_id),
jsons AS (SELECT 'json-' || c_nationkey AS pid, 'json' AS kind, '[' || string_agg('{"id": ' || c_custkey || ', "name": "' || c_name || '", "seg": "' || c_mktsegment || '"}', ',' ORDER BY c_custkey) || ']' AS content FROM customer GROUP BY c_nationkey),
envelopes AS (SELECT 'envelope-' || s_nationkey AS pid, 'envelope' AS kind, '{"data": [' || string_agg('{"id": ' || s_suppkey || ', "name": "' || s_name || '"}', ',' ORDER BY s_suppkey) || '], "meta": {"page": 1}}' AS content FROM supplier GROUP BY s_nationkey),
csvs AS (SELECT 'csv-' || p_brand AS pid, 'csv' AS kind, 'key,name,type,size' || chr(10) || string_agg(p_partkey || ',' || p_name || ',' || p_type || ',' || p_size, chr(10) ORDER BY p_partkey) AS content FROM part GROUP BY p_brand),
dh AS (SELECT 'c' || conv_id AS key, turn, CASE role WHEN 'user' THEN '-' WHEN 'assistant' THEN '+' ELSE ' ' END AS sg, text FROM conversations WHERE text IS NOT NULL),
diffs AS (SELECT 'diff-' || key AS pid, 'diff' AS kind, 'diff --git a/' || key || '.txt b/' || key || '.txt' || chr(10) || '--- a/' || key || '.txt' || chr(10) || '+++ b/' || key || '.txt' || chr(10) || string_agg('@@ -' || turn || ',3 +' || turn || ',4 @@' || chr(10) || sg || replace(text, chr(10), chr(10) || sg), chr(10) ORDER BY turn) AS content FROM dh GROUP BY key),
greps AS (SELECT 'grep-' || doc_id AS pid, 'grep' AS kind, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: 'docs/' || doc_id || '.txt:' || i || ':' || x), chr(10)) AS content FROM documents WHERE text IS NOT NULL),
codes AS (SELECT 'code-' || p_type AS pid, 'code' AS kind, 'import math' || chr(10) || chr(10) || string_agg('def part_' || p_partkey || '(size):' || chr(10) || '    # ' || p_name || chr(10) || '    return size + ' || p_size || chr(10), chr(10) ORDER BY p_partkey) AS content FROM part GROUP BY p_type),
texts AS (SELECT 'text-' || doc_id AS pid, 'text' AS kind, text AS content FROM documents),
pay AS (SELECT * FROM logs UNION ALL SELECT * FROM jsons UNION ALL SELECT * FROM envelopes UNION ALL SELECT * FROM csvs UNION ALL SELECT * FROM diffs UNION ALL SELECT * FROM greps UNION ALL SELECT * FROM codes UNION ALL SELECT * FROM texts)
"""
