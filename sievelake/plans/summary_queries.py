"""Queries over summaries of collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.operators import summary as M
from sievelake.plans import payloads as P
from sievelake.plans import profile_queries as Q

FIELDS = ["event_type", "value", "props", "detail", "flag"]


def c(spark, sf):
    return Q.event_cells(spark, sf).where(F.col("field").isin(*FIELDS))


def q_summary(spark, sf):
    s = M.summarize(c(spark, sf))
    join = lambda name, f: F.array_join(F.transform(name, f), ",").alias(name)
    return s.select(
        "coll", "rows", join("schema", lambda x: F.concat(x["field"], F.lit("="), x["type"])), join("ranges", lambda x: F.concat(x["field"], F.lit(":"), F.round(x["lo"] * 100).cast("bigint").cast("string"), F.lit("-"), F.round(x["hi"] * 100).cast("bigint").cast("string"))),
        F.size("values").alias("values"), join("examples", lambda x: F.concat(x["value"], F.lit("@"), x["ord"].cast("string"))), join("sample", lambda x: x["ord"].cast("string")),
    )


QUERIES = {
    "agg_summary": q_summary,
    "agg_type_histogram": lambda spark, sf: M.type_histogram(c(spark, sf)),
    "agg_categorical": lambda spark, sf: M.categorical(c(spark, sf)),
    "agg_top_value_counts": lambda spark, sf: M.top_value_counts(c(spark, sf)),
    "agg_primary_field": lambda spark, sf: M.primary_field(c(spark, sf)),
    "agg_examples": lambda spark, sf: M.examples(c(spark, sf)),
    "agg_sample_rows": lambda spark, sf: M.sample_rows(c(spark, sf)),
    "agg_error_lines": lambda spark, sf: P.payloads(spark, sf).select("pid", F.array_join(M.error_lines(F.col("content")), "\n").alias("lines")),
    "agg_row_truncate": lambda spark, sf: M.truncated_cells(_long(spark, sf)),
}


def _long(spark, sf):
    from sievelake.collections import cells, table

    return cells(table(spark, sf, "documents").select(F.col("doc_id").alias("coll"), F.lit(0).alias("ord"), "text", "n_chars"), "coll", ["text", "n_chars"])


_W = (
    Q._with(FIELDS)
    + """, ty AS (SELECT coll, field, CASE WHEN kind = 'numeric' THEN CASE WHEN regexp_matches(s, '^-?[0-9]+$') THEN 'int' ELSE 'float' END WHEN kind = 'boolean' THEN 'bool' WHEN kind = 'string' THEN 'str' ELSE 'null' END AS type, count(*) AS n FROM c GROUP BY 1, 2, 3),
th AS (SELECT coll, field, type FROM (SELECT *, row_number() OVER (PARTITION BY coll, field ORDER BY n DESC, type) AS r FROM ty) WHERE r = 1),
sz AS (SELECT coll, count(DISTINCT ord) AS n FROM c GROUP BY 1), ca0 AS (SELECT coll, field, count(DISTINCT s) FILTER (kind != 'null') AS "distinct", count(*) AS coverage FROM c GROUP BY 1, 2),
ca AS (SELECT ca0.* FROM ca0 JOIN sz USING (coll) WHERE "distinct" > 0 AND ("distinct" <= 50 OR "distinct" < 0.02 * n)),
vc AS (SELECT c.coll, c.field, c.s, "distinct", count(*) AS n, min(ord) AS ord FROM c JOIN ca USING (coll, field) WHERE kind != 'null' GROUP BY ALL),
tv AS (SELECT coll, field, s AS value, "distinct", n FROM (SELECT *, row_number() OVER (PARTITION BY coll, field ORDER BY n DESC, s) AS r FROM vc) WHERE r <= 20),
pf AS (SELECT coll, field FROM (SELECT *, row_number() OVER (PARTITION BY coll ORDER BY coverage DESC, "distinct" DESC, field) AS r FROM ca) WHERE r = 1),
ex AS (SELECT coll, field, s AS value, ord FROM (SELECT vc.*, row_number() OVER (PARTITION BY coll, field ORDER BY n DESC, ord) AS r FROM vc JOIN pf USING (coll, field)) WHERE r <= 20),
rw AS (SELECT coll, ord, row_number() OVER (PARTITION BY coll ORDER BY ord) - 1 AS pos, count(*) OVER (PARTITION BY coll) AS n FROM (SELECT DISTINCT coll, ord FROM c)),
sa AS (SELECT coll, ord FROM rw WHERE list_contains(list_transform(range(0, least(n, 6)), lambda i: CASE WHEN least(n, 6) = 1 THEN 0 ELSE i * (n - 1) // (least(n, 6) - 1) END), pos))
"""
)
_N = "len(string_split(content, chr(10)))"
ORACLES = {
    "agg_type_histogram": _W + "SELECT * FROM th",
    "agg_categorical": _W + "SELECT * FROM ca",
    "agg_top_value_counts": _W + "SELECT * FROM tv",
    "agg_primary_field": _W + "SELECT * FROM pf",
    "agg_examples": _W + "SELECT * FROM ex",
    "agg_sample_rows": _W + "SELECT * FROM sa",
    "agg_error_lines": f"WITH {P.SQL} SELECT pid, array_to_string(list_slice(list_transform(list_filter(CASE WHEN {_N} > 16 THEN list_slice(string_split(content, chr(10)), 13, {_N} - 4) ELSE [] END, lambda x: regexp_matches(x, '{M.SEVERE}')), lambda x: left(x, 240)), 1, 15), chr(10)) AS lines FROM pay",
    "agg_row_truncate": "SELECT doc_id AS coll, 0::INT AS ord, 'text' AS field, CASE WHEN length(text) > 120 THEN left(text, 120) || '… [' || length(text) || ' chars]' ELSE text END AS shown FROM documents UNION ALL SELECT doc_id, 0, 'n_chars', n_chars::VARCHAR FROM documents",
    "agg_summary": _W
    + """, a AS (SELECT coll, string_agg(field || '=' || type, ',' ORDER BY field) AS schema FROM th GROUP BY 1), b AS (SELECT coll, string_agg(field || ':' || lo || '-' || hi, ',' ORDER BY field) AS ranges FROM (SELECT coll, field, round(min(x) * 100)::BIGINT AS lo, round(max(x) * 100)::BIGINT AS hi FROM c WHERE x IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
v AS (SELECT coll, count(*)::INT AS "values" FROM tv GROUP BY 1), x AS (SELECT coll, string_agg(value || '@' || ord, ',' ORDER BY value, ord) AS examples FROM ex GROUP BY 1), s AS (SELECT coll, string_agg(ord, ',' ORDER BY ord) AS sample FROM sa GROUP BY 1)
SELECT sz.coll, sz.n AS rows, schema, ranges, "values", examples, sample FROM sz LEFT JOIN a USING (coll) LEFT JOIN b USING (coll) LEFT JOIN v USING (coll) LEFT JOIN x USING (coll) LEFT JOIN s USING (coll)""",
}
