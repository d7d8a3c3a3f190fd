"""Store entries and messages with markers, derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.collections import table

#: The moment at which entries are live or expired, in epoch seconds.
NOW = 1_700_010_000


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """One entry per document: created a second apart modulo 20,000."""
    d = table(spark, sf, "documents")
    key = F.substring(F.sha2(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), 256), 1, 24)
    return d.select(
        key.alias("hash_key"),
        "doc_id",
        F.col("text").alias("original_content"),
        F.substring("text", 1, 40).alias("compressed_content"),
        F.floor(F.length("text") / 4).alias("original_tokens"),
        F.floor(F.length("text") / 40).alias("compressed_tokens"),
        F.col("source").alias("tool_name"),
        F.concat(F.lit("ns"), (F.col("doc_id") % 4).cast("string")).alias("namespace"),
        (F.lit(NOW) - (F.col("doc_id") * 7) % 20000).alias("created_at"),
        F.when(F.col("doc_id") % 5 == 0, 600).otherwise(7200).alias("ttl"),
        F.when(F.col("doc_id") % 2 == 0, "smart_crusher").otherwise("log").alias("compression_strategy"),
        (F.col("doc_id") % 6).alias("retrieval_count"),
    )


def marked_messages(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text): a third with two markers, a third plain, a third null."""
    h = lambda n: F.substring(F.sha2(F.concat(F.lit("doc-"), n.cast("string")), 256), 1, 24)
    two = F.concat(F.lit("see [9 rows compressed to 0. Retrieve more: hash="), h(F.col("doc_id") * 2), F.lit("] or <<ccr:"), h(F.col("doc_id")), F.lit(" 7_rows>> end"))
    text = F.when(F.col("doc_id") % 3 == 0, "plain text").when(F.col("doc_id") % 3 == 1, two)
    return table(spark, sf, "documents").select("doc_id", text.alias("text"))


SQL = f"""store AS (SELECT substr(sha256('doc-' || doc_id), 1, 24) AS hash_key, doc_id, text AS original_content, left(text, 40) AS compressed_content, length(text) // 4 AS original_tokens, length(text) // 40 AS compressed_tokens,
  source AS tool_name, 'ns' || doc_id % 4 AS namespace, {NOW} - (doc_id * 7) % 20000 AS created_at, CASE WHEN doc_id % 5 = 0 THEN 600 ELSE 7200 END AS ttl, CASE WHEN doc_id % 2 = 0 THEN 'smart_crusher' ELSE 'log' END AS compression_strategy, doc_id % 6 AS retrieval_count FROM documents)"""
