"""A corpus pipeline: language ID, near-dedup, secret scans, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns the next stage's documents
(the last one: packed sequences' pieces). ``run`` writes and rereads each
stage's rows in the folder that the cluster shares.

For all stages: ``docs`` has the five columns of documents; more columns,
whatever their names, are dropped. Any value may be null. An empty table gives
an empty one. No order of rows matters, and results don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelake.llm import langid, mixing, neardup, packing, secrets
from sievelake.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents per language that the language models are fitted on, about.
LANGID_SAMPLE = 250


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models reject go (no letters, or letters far from
    every learned language); lang is set to the language found.

    A null or empty text has no letters and goes. Where no row has both text and
    lang, nothing is learned and all rows go. Ties take the first language by
    name; repeated rows are judged alike and all stay; very long texts are
    judged whole."""
    docs = docs.select(*COLUMNS)
    models = langid.fit_models(langid.training_sample(docs, "doc_id", "text", "lang", LANGID_SAMPLE))
    found = langid.identify(docs, models, keep=True).where("not rejected")
    return found.drop("lang").withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the least doc_id's,
    null last, and of rows that repeat it the least by a digest of all columns.

    Texts that are null or without words are linked with nothing and stay; of
    such rows that are equal in every column one does. Very long texts are
    compared on their full sets."""
    return neardup.one_per_group(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts and n_chars set anew; no document goes.

    Null texts stay null, and texts without secrets are untouched; overlapping
    spans are replaced once; repeated rows change alike."""
    return secrets.redact_documents(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are replicated to the sources' target weights and shuffled.

    A null source is one of its own; a source without any text has no size and
    goes. A repeated row draws the count of its id, null ids that of the empty
    one, and every copy of every row stays."""
    return mixing.mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of sequences in target proportions: per piece doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id and offset.

    Null and empty texts are the end id alone; a null source is that of empty
    name; repeated rows are packed again; long texts are cut without loss."""
    return packing.pieces_of(packing.pack_mixture(docs.select(*COLUMNS)))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Language models and tokenisation are not SQL; tests hold the result against
#: a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
