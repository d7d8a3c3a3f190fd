import corpus_pipeline
from sievelake.llm import neardup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
A, B, C = "a b c d e f g", "h i j k l m n", "o p q r s t u"


def test_one_row_of_each_group(spark, sf):
    rows = [(3, A), (1, A.upper()), (1, A), (None, A), (1, A)]  # one group, the least id twice with other texts
    rows += [(5, B), (4, B), (5, "v w x y z 1 2")]  # 5 stays with its other text only
    rows += [(None, C), (None, C)]
    rows += [(7, None), (8, None), (8, None), (None, ""), (9, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(4)
    for out in (neardup.one_per_group(df), corpus_pipeline.drop_near_duplicates(spark, df, sf)):
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        assert out.columns == df.columns
        ones = [x for x in got if x[0] == 1]
        assert len(ones) == 1 and ones[0][1] in (A, A.upper())
        assert sorted((x for x in got if x[0] != 1), key=str) == sorted([(4, B), (5, "v w x y z 1 2"), (None, C), (7, None), (8, None), (None, ""), (9, "")], key=str)
    assert neardup.one_per_group(df.limit(0)).collect() == []


def test_choice_is_the_same_on_any_partitioning(spark):
    df = spark.createDataFrame([(i // 2, " ".join(f"w{i // 6}x{k}" for k in range(9)), "en", str(i), i) for i in range(60)], SCHEMA)
    out = [sorted(map(tuple, neardup.one_per_group(df.repartition(n)).collect())) for n in (1, 5)]
    assert out[0] == out[1] and len(out[0]) == 10 and [r[0] for r in out[0]] == [3 * k for k in range(10)]
