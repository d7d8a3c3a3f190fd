from pyspark.sql import functions as F
from sievelake.llm import mixing


def test_small_source_beside_a_hot_one_meets_its_weight(spark):
    rows = [(i, "x" * 200, "hot") for i in range(4000)] + [(10_000 + i, "x" * 10, "small") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("hot", 15.0), ("small", 1.0)], "source string, weight double")
    rates = {r.source: r.rate for r in mixing.source_rates(df, weights).collect()}
    assert abs(rates["small"] - 800_400 / 16 / 400) < 1e-6  # 125 copies of each
    out = mixing.mix_sources(df, weights)
    size = {r[0]: r[1] for r in out.groupBy("source").agg(F.sum(F.length("text"))).collect()}
    total = sum(size.values())
    assert abs(size["small"] / total - 1 / 16) < 0.006 and abs(total / 800_400 - 1) < 0.06
    copies = [r[1] for r in out.where("source = 'small'").groupBy("doc_id").agg(F.count("*")).collect()]
    assert len(copies) == 40 and len(set(copies)) > 10 and 85 < min(copies) and max(copies) < 170
    again = mixing.mix_sources(df.repartition(3), weights)
    assert sorted(map(tuple, out.select("doc_id", "copy_no", "mix_key").collect())) == sorted(map(tuple, again.select("doc_id", "copy_no", "mix_key").collect()))


def test_counts_of_large_means(spark):
    df = spark.range(3000).withColumn("m", F.when(F.col("id") % 2 == 0, 33.0).otherwise(400.0))
    r = df.withColumn("k", mixing.poisson_count(F.col("m"), 17, F.col("id"))).groupBy("m").agg(F.avg("k").alias("mean"), F.var_samp("k").alias("var")).collect()
    for x in r:
        assert abs(x["mean"] - x.m) < 4 * (x.m / 1500) ** 0.5 and abs(x["var"] / x.m - 1) < 0.2


def test_sql_of_the_query_at_rates_beyond_one_draw(spark, tmp_path):
    import duckdb
    from sievelake.llm import queries

    rows = [(i, "x" * 200, "en", "hot", 200) for i in range(1500)] + [(9000 + i, "y" * 10, "en", "small", 10) for i in range(3)] + [(9000, "y" * 10, "en", "small", 10), (9100, None, None, None, 0), (None, "zz", "de", None, 2)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_mixing(spark, str(tmp_path)).select("doc_id", "source", "copy_no", "mix_key").collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"select doc_id, source, copy_no, mix_key from ({queries.ORACLE_SQL['op8_mixing']})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) > 1700
