"""Queries over the lossless encodings. A collection is a page of a hundred
consecutive orders, so collections stay small at any scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.collections import cells, table
from sievelake.operators import encode as E
from sievelake.operators import profile as P
from sievelake.plans import payloads

FIELDS = ["n", "kind", "moment", "price", "status", "path", "label", "note"]


def rows(spark, sf):
    key, prio = F.col("o_orderkey").cast("string"), F.substring("o_orderpriority", 1, 1)
    return table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 100).alias("coll"),
        (F.col("o_orderkey") % 100).alias("ord"),
        F.col("o_orderkey").alias("n"),
        F.lit("order").alias("kind"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("moment"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"),
        F.concat(F.lit("orders/"), "o_orderstatus", F.lit("/p"), prio, F.lit(":"), key).alias("path"),
        F.concat(F.lit("ORD-"), key, F.lit("-"), prio, F.lit("/done")).alias("label"),
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit('say "'), key, F.lit('", ok'))).alias("note"),
    )


def c(spark, sf, *fields):
    return cells(rows(spark, sf), "coll", list(fields or FIELDS))


def _big(df):
    return df.select(*[F.col(n).cast("bigint").alias(n) if t == "int" else F.col(n) for n, t in df.dtypes])


def q_flatten(spark, sf):
    nested = rows(spark, sf).select("coll", "ord", F.struct("n", "status").alias("o"))
    return E.flatten(nested, "o").select("coll", "ord", F.col("`o.n`").alias("o_n"), F.col("`o.status`").alias("o_status"))


def q_const(spark, sf):
    return E.constants(c(spark, sf))


def q_arith(spark, sf):
    return E.arithmetic(c(spark, sf))


def q_iso(spark, sf):
    return E.iso_deltas(c(spark, sf, "moment", "status"))


def q_decimal(spark, sf):
    return _big(E.decimals(c(spark, sf, "price", "status")))


def q_dict(spark, sf):
    ents, codes = E.dictionary(c(spark, sf, "status", "label"))
    a = ents.select("coll", "field", F.lit("entry").alias("part"), F.lit(-1).cast("bigint").alias("ord"), F.col("code").cast("bigint").alias("code"), "value")
    return a.unionByName(codes.select("coll", "field", F.lit("cell").alias("part"), "ord", F.col("code").cast("bigint").alias("code"), F.lit(None).cast("string").alias("value")))


def q_head(spark, sf):
    heads, codes = E.head_dictionary(c(spark, sf, "path", "status"))
    a = heads.select("coll", "field", F.lit("head").alias("part"), F.lit(-1).cast("bigint").alias("ord"), F.col("code").cast("bigint").alias("code"), F.col("head").alias("value"))
    return a.unionByName(codes.select("coll", "field", F.lit("cell").alias("part"), "ord", F.col("code").cast("bigint").alias("code"), F.col("rest").alias("value")))


def q_affix(spark, sf):
    return E.affixes(c(spark, sf, "path", "label", "status"))


def q_ditto(spark, sf):
    return E.ditto(c(spark, sf, "kind", "moment", "note"))


def q_buckets(spark, sf):
    return E.buckets(c(spark, sf))


def q_type_tag(spark, sf):
    return E.type_tags(c(spark, sf))


def q_render(spark, sf):
    return E.render(c(spark, sf, "n", "status", "price", "note"))


def q_kv(spark, sf):
    return E.render_kv(c(spark, sf, "n", "status", "note"))


def q_stats_line(spark, sf):
    return E.stats_lines(P.numeric_stats(c(spark, sf, "n", "price")))


def q_demote(spark, sf):
    every = c(spark, sf, "status", "kind")
    return E.demoted(every.where("ord < 3"), every)


def q_compact(spark, sf):
    return E.compact_plan(c(spark, sf))


def q_document(spark, sf):
    return E.compact_document(payloads.envelopes(spark, sf), "pid", "content")


def q_ordered(spark, sf):
    return E.column_order(c(spark, sf))


QUERIES = {
    "enc_compact": q_compact, "enc_flatten": q_flatten, "enc_const": q_const, "enc_arith": q_arith, "enc_iso": q_iso, "enc_decimal": q_decimal, "enc_dict": q_dict,
    "enc_head": q_head, "enc_affix": q_affix, "enc_ditto": q_ditto, "enc_buckets": q_buckets, "enc_type_tag": q_type_tag, "enc_render": q_render, "snk_csv_schema": q_render,
    "enc_kv": q_kv, "enc_stats_line": q_stats_line, "enc_demote": q_demote, "enc_document": q_document, "enc_column_order": q_ordered,
}

_R = """r AS (SELECT o_orderkey // 100 AS coll, o_orderkey % 100 AS ord, o_orderkey AS n, 'order' AS kind, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS moment, o_totalprice AS price, o_orderstatus AS status,
  'orders/' || o_orderstatus || '/p' || left(o_orderpriority, 1) || ':' || o_orderkey AS path, 'ORD-' || o_orderkey || '-' || left(o_orderpriority, 1) || '/done' AS label, CASE WHEN o_orderkey % 7 = 0 THEN 'say "' || o_orderkey || '", ok' END AS note FROM orders)"""


def _w(*fields: str) -> str:
    each = " UNION ALL ".join(f"SELECT coll, ord, '{f}' AS field, {'1' if f in ('n', 'price') else '0'} AS num, {f}::VARCHAR AS s FROM r" for f in fields or FIELDS)
    return f"WITH {_R}, c AS ({each})"


_ISO = ", z AS (SELECT *, epoch(strptime(s, '%Y-%m-%dT%H:%M:%S'))::BIGINT AS t FROM c WHERE field = 'moment'), iso AS (SELECT coll, field, ord, CASE WHEN lag(t) OVER w IS NULL THEN s ELSE CASE WHEN t >= lag(t) OVER w THEN '+' ELSE '' END || (t - lag(t) OVER w) END AS cell FROM z WINDOW w AS (PARTITION BY coll, field ORDER BY ord))"
_DEC = """, f0 AS (SELECT *, regexp_extract(s, '\\.([0-9]+)$', 1) AS frac, bool_and(regexp_matches(s, '^-?(0|[1-9][0-9]*)(\\.[0-9]+)?$')) OVER (PARTITION BY coll, field) AS ok FROM c),
f1 AS (SELECT *, max(length(frac)) OVER (PARTITION BY coll, field) AS k FROM f0 WHERE ok),
dec AS (SELECT coll, field, k, ord, CASE WHEN s LIKE '-%' THEN '-' ELSE '' END || regexp_replace(regexp_extract(s, '^-?([0-9]+)', 1) || rpad(frac, k::INT, '0'), '^0+([0-9])', '\\1') AS cell, length(frac) AS places FROM f1 WHERE k BETWEEN 1 AND 12)"""
_DICT = """, v0 AS (SELECT coll, field, s, min(ord) AS first, count(*) AS n FROM c GROUP BY 1, 2, 3),
v1 AS (SELECT *, count(*) OVER w AS kinds, sum(n) OVER w AS rows, bool_or(s IS NULL OR contains(s, chr(10))) OVER w AS bad, row_number() OVER (PARTITION BY coll, field ORDER BY first) - 1 AS code FROM v0 WINDOW w AS (PARTITION BY coll, field)),
ent AS (SELECT coll, field, code, s AS value FROM v1 WHERE kinds >= 2 AND kinds < rows AND NOT bad),
cod AS (SELECT c.coll, c.field, c.ord, code FROM c JOIN ent ON c.coll = ent.coll AND c.field = ent.field AND c.s = ent.value)"""
_HEAD = """, h0 AS (SELECT *, regexp_extract(s, '^(.*[/:.])[^/:.]*$', 1) AS head FROM c WHERE s IS NOT NULL),
h1 AS (SELECT coll, field, head, min(ord) AS first, count(*) AS n FROM h0 GROUP BY 1, 2, 3),
h2 AS (SELECT *, count(*) OVER w AS kinds, sum(n) OVER w AS rows, bool_or(head = '') OVER w AS bad, row_number() OVER (PARTITION BY coll, field ORDER BY first) - 1 AS code FROM h1 WINDOW w AS (PARTITION BY coll, field)),
hd AS (SELECT coll, field, code, head FROM h2 WHERE kinds >= 2 AND kinds < rows AND rows >= 16 AND NOT bad),
hc AS (SELECT h0.coll, h0.field, h0.ord, code, substr(s, length(h0.head) + 1) AS rest FROM h0 JOIN hd USING (coll, field, head))"""


def _lcp(a: str, b: str) -> str:
    return f"(SELECT count(*) FROM (SELECT unnest(range(1, least(length({a}), length({b})) + 1)) AS i) WHERE left({a}, i) = left({b}, i))"


_AFF = f""", a0 AS (SELECT coll, field, count(*) AS n, count(s) AS k, min(s) AS lo, max(s) AS hi, min(reverse(s)) AS blo, max(reverse(s)) AS bhi, min(length(s)) AS short FROM c GROUP BY 1, 2),
a1 AS (SELECT *, {_lcp("lo", "hi")} AS p, {_lcp("blo", "bhi")} AS q0 FROM a0 WHERE n >= 2 AND k = n AND lo != hi),
aff AS (SELECT coll, field, left(lo, p::INT) AS prefix, reverse(left(blo, least(q0, short - p)::INT)) AS suffix FROM a1 WHERE p + least(q0, short - p) >= 2)"""
_CONST = ", con AS (SELECT coll, field, min(s) AS value FROM c GROUP BY 1, 2 HAVING count(*) >= 2 AND count(s) = count(*) AND min(s) = max(s) AND min(s) != '')"
_ARITH = """, d0 AS (SELECT *, TRY_CAST(CASE WHEN regexp_matches(s, '^(0|-?[1-9][0-9]{0,17})$') THEN s END AS BIGINT) AS v FROM c), d1 AS (SELECT *, v - lag(v) OVER (PARTITION BY coll, field ORDER BY ord) AS d FROM d0),
ari AS (SELECT coll, field, arg_min(v, ord) AS base, min(d) AS step, count(*) AS n FROM d1 GROUP BY 1, 2 HAVING count(*) >= 3 AND count(v) = count(*) AND min(d) = max(d) AND min(d) != 0)"""
_TAGS = ", tag AS (SELECT coll, field, CASE WHEN count(s) = 0 THEN 'null' WHEN field = 'n' THEN 'int' WHEN field = 'price' THEN 'float' ELSE 'string' END AS tag, count(s) < count(*) AS nullable, row_number() OVER (PARTITION BY coll ORDER BY count(s) DESC, field) AS pos FROM c GROUP BY 1, 2)"

ORACLES = {
    "enc_flatten": f"WITH {_R} SELECT coll, ord, n AS o_n, status AS o_status FROM r",
    "enc_const": _w() + _CONST + " SELECT * FROM con",
    "enc_arith": _w() + _ARITH + " SELECT * FROM ari",
    "enc_iso": _w("moment", "status") + _ISO + " SELECT * FROM iso",
    "enc_decimal": _w("price", "status") + _DEC + " SELECT * FROM dec",
    "enc_dict": _w("status", "label") + _DICT + " SELECT coll, field, 'entry' AS part, -1::BIGINT AS ord, code, value FROM ent UNION ALL SELECT coll, field, 'cell', ord, code, NULL FROM cod",
    "enc_head": _w("path", "status") + _HEAD + " SELECT coll, field, 'head' AS part, -1::BIGINT AS ord, code, head AS value FROM hd UNION ALL SELECT coll, field, 'cell', ord, code, rest FROM hc",
    "enc_affix": _w("path", "label", "status") + _AFF + " SELECT * FROM aff",
    "enc_ditto": _w("kind", "moment", "note") + " SELECT coll, field, ord, CASE WHEN length(s) > 1 AND s IS NOT DISTINCT FROM lag(s) OVER (PARTITION BY coll, field ORDER BY ord) THEN '=' ELSE s END AS cell FROM c",
    "enc_buckets": _w() + ", sz AS (SELECT coll, count(DISTINCT ord) AS rows FROM c GROUP BY 1), g AS (SELECT coll, field, count(DISTINCT s) AS kinds, count(s) AS k, max(num) AS num FROM c GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY coll ORDER BY kinds DESC, field) AS rn FROM g JOIN sz USING (coll) WHERE num = 0 AND k = rows AND kinds BETWEEN 2 AND 8 AND kinds <= 0.7 * rows) SELECT coll, field, kinds AS n_buckets FROM b WHERE rn = 1",
    "enc_type_tag": _w() + _TAGS + " SELECT coll, field, tag, nullable FROM tag",
    "enc_column_order": _w() + _TAGS + " SELECT coll, field, pos::INT AS pos FROM tag",
    "enc_render": _w("n", "status", "price", "note") + _TAGS + """, q AS (SELECT c.coll, c.ord, pos, CASE WHEN s IS NULL THEN '__null__' WHEN regexp_matches(s, '[,"\\n\\r]') OR s IN ('__null__', '__missing__', '=', '') THEN '"' || replace(s, '"', '""') || '"' ELSE s END AS t FROM c JOIN tag USING (coll, field)),
l AS (SELECT coll, ord, string_agg(t, ',' ORDER BY pos) AS line FROM q GROUP BY 1, 2), b AS (SELECT coll, count(*) AS k, string_agg(line, chr(10) ORDER BY ord) AS body FROM l GROUP BY 1),
h AS (SELECT coll, string_agg(field || ':' || tag || CASE WHEN nullable THEN '?' ELSE '' END, ',' ORDER BY pos) AS cols FROM tag GROUP BY 1) SELECT coll, '[' || k || '/' || k || ']{' || cols || '}' || chr(10) || body AS text FROM b JOIN h USING (coll)""",
    "enc_kv": _w("n", "status", "note") + _TAGS + " SELECT c.coll, c.ord, string_agg('- ' || field || ': ' || s, chr(10) ORDER BY pos) AS text FROM c JOIN tag USING (coll, field) WHERE s IS NOT NULL GROUP BY 1, 2",
    "enc_stats_line": _w("n", "price") + """, st AS (SELECT coll, field, min(s::DOUBLE) AS mn, max(s::DOUBLE) AS mx, sum(s::DECIMAL(30, 6))::DOUBLE AS sm, count(*) AS k FROM c GROUP BY 1, 2)
SELECT coll, '__stats: ' || string_agg(printf('%s(min=%.2f max=%.2f sum=%.2f n=%d)', field, mn, mx, sm, k), ' ' ORDER BY field) AS text FROM st GROUP BY 1""",
    "enc_demote": _w("status", "kind") + ", a AS (SELECT coll, field FROM c WHERE ord < 3 GROUP BY 1, 2 HAVING count(*) >= 2 AND min(s) = max(s) AND count(s) = count(*)), b AS (SELECT coll, field FROM c GROUP BY 1, 2 HAVING count(*) >= 2 AND min(s) = max(s) AND count(s) = count(*)) SELECT * FROM a EXCEPT SELECT * FROM b",
    "enc_compact": _w() + _CONST + _ARITH + _ISO + _DEC + _DICT + _HEAD + _AFF + """, pl AS (SELECT coll, field, sum(length(coalesce(s, '__null__')) + 1) AS plain FROM c GROUP BY 1, 2),
o AS (SELECT coll, field, 0 AS rk, 'const' AS e, 0 AS cost FROM con UNION ALL SELECT coll, field, 1, 'arith', 1 FROM ari UNION ALL SELECT coll, field, 2, 'iso', sum(length(cell) + 1) FROM iso GROUP BY 1, 2 UNION ALL SELECT coll, field, 3, 'decimal', sum(length(cell) + 1) FROM dec GROUP BY 1, 2
 UNION ALL SELECT coll, field, 4, 'dict', a + b FROM (SELECT coll, field, sum(length(value) + 1) AS a FROM ent GROUP BY 1, 2) JOIN (SELECT coll, field, sum(length(code::VARCHAR) + 1) AS b FROM cod GROUP BY 1, 2) USING (coll, field)
 UNION ALL SELECT coll, field, 5, 'head', a + b FROM (SELECT coll, field, sum(length(head) + 1) AS a FROM hd GROUP BY 1, 2) JOIN (SELECT coll, field, sum(length(code::VARCHAR) + length(rest) + 2) AS b FROM hc GROUP BY 1, 2) USING (coll, field)
 UNION ALL SELECT c.coll, c.field, 6, 'affix', sum(length(s) - length(prefix) - length(suffix) + 1) + max(length(prefix) + length(suffix)) FROM c JOIN aff USING (coll, field) GROUP BY 1, 2),
f AS (SELECT coll, field, arg_min(e, rk) AS e FROM o JOIN pl USING (coll, field) WHERE rk = 0 OR cost < plain GROUP BY 1, 2) SELECT coll, field, coalesce(e, 'plain') AS encoding FROM pl LEFT JOIN f USING (coll, field)""",
    "enc_document": """WITH s AS (SELECT 'envelope-' || s_nationkey AS pid, count(*) AS n, string_agg('[' || s_suppkey || ',"' || s_name || '"]', ',' ORDER BY s_suppkey) AS r, string_agg('{"id":' || s_suppkey || ',"name":"' || s_name || '"}', ',' ORDER BY s_suppkey) AS o FROM supplier GROUP BY s_nationkey)
SELECT pid, CASE WHEN n >= 2 THEN '{"data":{"cols":["id","name"],"rows":[' || r || ']},"meta":{"page":1}}' ELSE '{"data":[' || o || '],"meta":{"page":1}}' END AS compact, (n >= 2)::INT AS tables FROM s""",
}
ORACLES["snk_csv_schema"] = ORACLES["enc_render"]
