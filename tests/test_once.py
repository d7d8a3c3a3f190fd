"""What is read or computed once."""

import math

from pyspark.sql import functions as F
from sievelake.functions import text as T
from sievelake.operators import reduce as R
from sievelake.operators import relevance as V
from sievelake.plans import store_queries as Q


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_time_is_read_once(spark, sf):
    assert plan(Q.q_dates(spark, sf)).count("gettimestamp") == 1


def test_search_reads_texts_once(spark):
    df = spark.createDataFrame([(1, "red bolt red"), (2, "blue ring"), (3, None)], "k bigint, t string")
    best = V.search_all(df, "k", "t", "red bolt")
    assert "regexp_extract_all" not in plan(best)
    assert [r.k for r in best.collect()] == [1]


def test_entropy_by_what_a_text_is_shorter_without_a_character(spark):
    texts = ["aab", "", "äöä😀😀x", "x", "0123456789abcdef" * 4]
    got = [r.b for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.shannon_bits(F.col("t")).alias("b")).collect()]
    want = [-sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)) for t in texts]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))


def test_secrets_by_their_first_letters(spark):
    keys = ["AKIA" + "A" * 16, "xAKIA" + "A" * 16, "ghp_" + "a" * 20, "a github_pat_" + "a" * 20, "sk-" + "a" * 20, "eyJ" + "a" * 5 + "." + "b" * 8 + "." + "c" * 8, "-----BEGIN x", "gh sk- eyJ AKIA"]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(keys)], "i int, t string").orderBy("i").select(T.has_prefixed_secret(F.col("t")).alias("s")).collect()]
    assert got == [True, False, True, True, True, True, True, False]


def test_grams_are_hashed_once():
    R._gram.cache_clear()
    R.simhash("abcdabcdabcd")
    R.simhash("abcdabcdabcd")
    assert R._gram.cache_info().misses == 4
