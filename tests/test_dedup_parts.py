"""Duplicates within a text: only what meets is compared."""

from sievelake.operators import prose as P

S = "idx bigint, n bigint, kind string, segment string"


def test_tiers_and_what_always_stays(spark):
    long = " ".join(f"w{i}x" for i in "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz")
    texts = ["one two", "three", "We met on 5 May here.", "we met on 7 may, here", "We met on 5 May here!", long + " end", long + " fin", "...", "", "one two", "last of all"]
    rows = [(k, i, len(texts), "prose", t) for k in (1, 2) for i, t in enumerate(texts)]
    got = sorted(map(tuple, P.text_dedup(spark.createDataFrame(rows, "k bigint, " + S), "k").collect()))
    assert got == [(k, i, t) for k in (1, 2) for i, t in ((3, "digits"), (4, "exact"), (6, "shingles"))]


def test_texts_are_dealt_out_once(spark):
    df = spark.createDataFrame([(1, 0, 1, "prose", "a b c d e")], "k bigint, " + S)
    plan = P.text_dedup(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "normalized" not in plan  # words come from a table that is written once
