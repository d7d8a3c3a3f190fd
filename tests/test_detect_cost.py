"""What is computed once per text, by the plan."""

from pyspark.sql import functions as F
from sievelake.functions import text as T
from sievelake.operators import detect as D


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_detection_cuts_a_text_once_for_all_detectors(spark):
    df = spark.createDataFrame([("a\nb",)], "t string").select(D.content_type(F.col("t")))
    assert plan(df).count("split(t#") == 1  # for all line detectors, up to 500 lines
    assert plan(df).count("split(trim(t#") == 1  # for tables


def test_detection_of_lines_past_the_head_and_of_odd_texts(spark):
    log = "2024-01-01 00:00:00 ERROR x\n" * 3
    texts = ["", " \n ", None, log, "x\n" * 200 + log, "a b\n" * 600 + "diff --git a b\n", "a,b\n" * 80, "\n\na,b\n" * 80, "def f():\n" * 3, "İFAİL\nſerror\nFaIl\nnpm ERR! x\n", "src/a.py:1: x\n" * 3]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(D.content_type(F.col("t")).content_type.alias("t")).collect()]
    assert got == ["text", "text", "text", "build", "text", "text", "json_array", "json_array", "source_code", "build", "search"]


def test_entities_are_counted_by_words(spark):
    texts = ["The Big dog Éa", "  \nThe Big", "A Bc\tDe", "", "one", " x Y", None]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.capitalized_entities(F.col("t")).alias("n")).collect()]
    assert got == [2, 1, 2, 0, 0, 0, None]
