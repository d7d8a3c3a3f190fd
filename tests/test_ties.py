"""Halves and ties that SQL decides."""

from pyspark.sql import functions as F
from sievelake.functions import text as T
from sievelake.operators import store as ST


def test_sizes_round_halves_to_even_as_c_does(spark):
    n = [0, 1023, 1024, 1280, 1792, 1024 * 1024 - 1, 1024 * 1024, 1024 * 1024 * 5 // 4, 1024 * 1024 * 7 // 4, 3 * 1024**3 + 5, *range(1000, 9000, 7), *range(10**6, 10**7, 65536)]
    got = [r.s for r in spark.createDataFrame([(x,) for x in n], "n int" if max(n) < 2**31 else "n bigint").coalesce(1).select(T.humanize_bytes(F.col("n")).alias("s")).collect()]
    assert got == [f"{x}B" if x < 1024 else "%.1fKB" % (x / 1024) if x < 1024 * 1024 else "%.1fMB" % (x / 1024 / 1024) for x in n]


def test_of_requests_at_one_second_the_first_by_id_comes_first(spark):
    rows = [(i, 0 if i < 3 else 5000, "a") for i in range(6)]
    df = spark.createDataFrame(rows[::-1], "id bigint, at bigint, k string").repartition(3)
    got = {r.id: r.hit for r in ST.result_cache(df, ["k"], "at", 100, tie="id").collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: True, 5: True}
