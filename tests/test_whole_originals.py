"""Store entries hold whole originals."""

from pyspark.sql import functions as F
from sievelake.plans import retrieve_queries as Q
from sievelake.plans.store_rows import entries


def test_originals_are_whole(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.original_content for r in entries(spark, sf).collect()} == docs
    longest = spark.read.parquet(f"{sf}/documents.parquet").agg(F.max(F.length("text"))).first()[0]
    assert longest > 400
    for r in Q.QUERIES["ret_by_hash"](spark, sf).collect():
        assert r.original_content == docs[r.doc_id]
