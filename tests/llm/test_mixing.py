import math

import pytest
from pyspark.sql import functions as F
from sievelake.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, copy_no string"


def test_poisson_inverse(spark):
    us = [0.0, 0.1, 0.367, 0.37, 0.5, 0.9, 0.99, 0.999999, 1 - 2**-52]
    df = spark.createDataFrame([(u, m) for u in us for m in (0.0, 0.3, 1.0, 7.5, 32.0)], "u double, m double")
    for r in df.withColumn("k", mixing.poisson_inverse(F.col("u"), F.col("m"))).collect():
        k, p = 0, math.exp(-r.m)
        c = p
        while r.m > 0 and c <= r.u and k < mixing.TERMS:
            k += 1
            p = p * r.m / k
            c += p
        assert r.k == k, (r.u, r.m)


def test_targets_are_met_and_runs_agree(spark):
    rows = [(i, "x" * (10 + i % 7), "hot" if i % 3 else f"s{i % 4}", "z") for i in range(12_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    weights = spark.createDataFrame([("hot", 1.0), ("s0", 1.0), ("s1", 2.0)], "source string, weight double")
    out = mixing.mix_sources(df, weights)
    size = {r[0]: r[1] for r in out.groupBy("source").agg(F.sum(F.length("text"))).collect()}
    assert set(size) == {"hot", "s0", "s1"}
    total = sum(size.values())
    for s, share in (("hot", 0.25), ("s0", 0.25), ("s1", 0.5)):
        assert abs(size[s] / total - share) < 0.03
    assert abs(total / sum(len(r[1]) for r in rows) - 1) < 0.06
    again = mixing.mix_sources(df.repartition(2), weights)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "a", "c"), (2, "", "a", "c"), (3, "text", None, "c"), (3, "text", None, "c"), (None, "t", None, "c")], SCHEMA)
    out = mixing.mix_sources(df, budget=20.0).collect()
    assert {r.source for r in out} == {None} and all(isinstance(r.copy_no, int) for r in out)
    threes = [r.copy_no for r in out if r.doc_id == 3]
    assert sorted(threes) == sorted(2 * list(range(len(threes) // 2)))
    assert mixing.mix_sources(df.limit(0)).collect() == []
    with pytest.raises(Exception):
        mixing.mix_sources(df.drop("source")).collect()
