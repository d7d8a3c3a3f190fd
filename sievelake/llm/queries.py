"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import bestfit, langid, lm, media, mixing, neardup, packing, secrets, url_filter, vectordup

# The rules of the url query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Documents per language that the language models are fitted on, about.
LANGID_SAMPLE = 250


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS t(host, path, verdict)")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces_of(packing.pack_mixture(_table(spark, sf_dir, "documents")))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out_of_sample = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    models = langid.fit_models(langid.training_sample(docs.where(~out_of_sample), "doc_id", "text", "lang", LANGID_SAMPLE))
    return langid.identify(docs, models).select("doc_id", out_of_sample.alias("held_out"), "lang_pred", "score", "rejected")


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.write_matrices(bestfit.pack_best_fit(_table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_media_columns, op3_url_filters, op4_packing, op5_lm_scoring, op6_language_id,
        op7_token_binary, op8_mixing, op9_secret_scans, op10_embedding_near_dedup, pipeline,
    )
}

_COMPONENTS = """
reach(a, c) AS (SELECT id, id FROM ids UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.c = l.a),
comp AS (SELECT a, min(c) AS component_id FROM reach GROUP BY a)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
cls AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
x AS (SELECT rep, n, unnest(s) AS g FROM cls),
hits AS (SELECT a.rep AS a, b.rep AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
half AS (SELECT a, b FROM hits WHERE 100 * k >= 80 * (na + nb - k)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
ids AS (SELECT rep AS id FROM cls),
{_COMPONENTS}
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
  d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM s d LEFT JOIN cls ON cls.s = list_sort(d.s) LEFT JOIN comp c ON c.a = cls.rep
""",
    "op3_url_filters": r"""
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT p.page_id, max(struct_pack(n := length(r.host || r.path), v := r.verdict, t := r.host || r.path)) AS m
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY 1)
SELECT p.page_id, p.host, p.path, m.t AS rule, coalesce(m.v, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)
""",
    "op8_mixing": r"""
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size FROM documents GROUP BY 1),
w AS (SELECT source, size, sqrt(size) AS weight FROM sizes),
r AS (SELECT source, CASE WHEN size > 0 THEN 1.0 * weight / (SELECT sum(weight) FROM w) * (SELECT sum(size) FROM w) / size ELSE 0.0 END AS rate FROM w),
q AS (SELECT source, greatest(1, ceil(rate / 32))::BIGINT AS parts, rate / greatest(1, ceil(rate / 32)) AS mean FROM r WHERE rate > 0),
d AS (SELECT *, row_number() OVER () AS row_no FROM documents),
u AS (SELECT row_no, source, ('0x' || substr(md5(CASE WHEN parts > 1 THEN 'part17:' || part ELSE '17' END || ':' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM (SELECT row_no, doc_id, d.source, parts, unnest(range(1, parts + 1)) AS part FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)),
t AS (SELECT source, mean, unnest(range(0, 96)) AS k FROM q),
c AS (SELECT source, k, sum(exp(-mean + CASE WHEN k > 0 THEN k * ln(mean) - lgamma(k + 1) ELSE 0 END)) OVER (PARTITION BY source ORDER BY k) AS c FROM t),
l AS (SELECT source, list(c ORDER BY k) AS c FROM c GROUP BY 1),
n AS (SELECT row_no, sum(len(list_filter(l.c, lambda x: x <= u.u))) AS n FROM u JOIN l ON u.source IS NOT DISTINCT FROM l.source GROUP BY 1),
e AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n::BIGINT)) AS copy_no FROM d JOIN n USING (row_no) WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(copy_no AS BIGINT) AS copy_no,
  ('0x' || substr(md5('order17:' || coalesce(doc_id::VARCHAR, '') || ':' || copy_no), 1, 15))::BIGINT AS mix_key FROM e
""",
    "op10_embedding_near_dedup": rf"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)),
g AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x != 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id != b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
ids AS (SELECT vec_id AS id FROM embeddings),
{_COMPONENTS},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
""",
}
