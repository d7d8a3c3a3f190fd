"""Summaries of record collections that answer at a glance: what columns there
are, how values are spread, one example per kind, and a few rows.

Inputs are the long form of :mod:`sievelake.collections`; every output is
bounded by the number of columns, not of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits. Fixed values.
CATEGORIES, CATEGORY_SHARE, TOP, SAMPLE, CLIP, LINE_CLIP, LINES = 50, 0.02, 20, 6, 120, 240, 15
SEVERE = r"(?i)\b(error|fatal|critical|panic|exception|traceback|failed|failure)\b"


def type_name(kind: Column, text: Column) -> Column:
    whole = text.rlike(r"^-?[0-9]+$")
    return F.when(kind == "numeric", F.when(whole, "int").otherwise("float")).when(kind == "boolean", "bool").when(kind == "string", "str").when(kind == "object", "dict").when(kind == "array", "list").otherwise("null")


def type_histogram(cells: DataFrame) -> DataFrame:
    """(coll, field, type): the most frequent type, the first by name on ties."""
    c = cells.groupBy("coll", "field", type_name(F.col("kind"), F.col("s")).alias("type")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("coll", "field").orderBy(F.desc("n"), "type")
    return c.withColumn("r", F.row_number().over(w)).where("r = 1").select("coll", "field", "type")


def _scalars(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("kind").isin("string", "numeric", "boolean"))


def categorical(cells: DataFrame) -> DataFrame:
    """(coll, field, distinct, coverage) of columns with few values: 50 at most,
    or under 2% of the rows. Nulls are no value; coverage counts rows that have
    the column at all."""
    n = cells.groupBy("coll").agg(F.count_distinct("ord").alias("n"))
    cov = cells.groupBy("coll", "field").agg(F.count("*").alias("coverage"))
    d = _scalars(cells).groupBy("coll", "field").agg(F.count_distinct("s").alias("distinct")).join(cov, ["coll", "field"]).join(n, "coll")
    return d.where((F.col("distinct") <= CATEGORIES) | (F.col("distinct") < CATEGORY_SHARE * F.col("n"))).select("coll", "field", "distinct", "coverage")


def clipped(text: Column, most: int = CLIP) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("… ["), F.length(text).cast("string"), F.lit(" chars]"))).otherwise(text)


def top_value_counts(cells: DataFrame, most: int = TOP) -> DataFrame:
    """(coll, field, value, n, distinct): the most frequent values of each
    categorical column, by count, then text."""
    kept = _scalars(cells).join(categorical(cells), ["coll", "field"])
    c = kept.groupBy("coll", "field", "s", "distinct").agg(F.count("*").alias("n"))
    w = Window.partitionBy("coll", "field").orderBy(F.desc("n"), "s")
    top = c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return top.groupBy("coll", "field", clipped(F.col("s")).alias("value"), "distinct").agg(F.sum("n").alias("n"))


def primary_field(cells: DataFrame) -> DataFrame:
    """(coll, field): the categorical column that most rows have, then the one
    with most values, then the first by name."""
    w = Window.partitionBy("coll").orderBy(F.desc("coverage"), F.desc("distinct"), "field")
    return categorical(cells).withColumn("r", F.row_number().over(w)).where("r = 1").select("coll", "field")


def examples(cells: DataFrame, most: int = TOP) -> DataFrame:
    """(coll, field, value, ord): the first row of each frequent value of the
    primary column."""
    c = _scalars(cells).join(primary_field(cells), ["coll", "field"]).groupBy("coll", "field", "s").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    w = Window.partitionBy("coll", "field").orderBy(F.desc("n"), "ord")
    return c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("coll", "field", clipped(F.col("s")).alias("value"), "ord")


def sample_rows(cells: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(coll, ord) of up to six rows evenly spread from the first to the last."""
    rows = cells.select("coll", "ord").distinct()
    w = Window.partitionBy("coll")
    r = rows.withColumn("pos", F.row_number().over(w.orderBy("ord")) - 1).withColumn("n", F.count("*").over(w)).withColumn("k", F.least(F.col("n"), F.lit(most)))
    steps = F.transform(F.sequence(F.lit(0), F.greatest(F.col("k") - 1, F.lit(0)).cast("int")), lambda i: F.when(F.col("k") == 1, 0).otherwise(F.floor(i * (F.col("n") - 1) / (F.col("k") - 1))).cast("bigint"))
    return r.where(F.array_contains(steps, F.col("pos").cast("bigint"))).select("coll", "ord")


def truncated_cells(cells: DataFrame) -> DataFrame:
    """Cells as shown in a preview: long strings clipped, containers named."""
    shown = F.when(F.col("kind") == "string", clipped(F.col("s"))).when(F.col("kind").isin("object", "array"), F.concat(F.lit("["), type_name(F.col("kind"), F.col("s")), F.lit(" omitted]"))).otherwise(F.col("s"))
    return cells.select("coll", "ord", "field", shown.alias("shown"))


def error_lines(text: Column, head: int = 12, tail: int = 4) -> Column:
    """Up to 15 severe lines of what lies between head and tail, clipped."""
    ls = F.split(text, "\n")
    mid = F.when(F.size(ls) > head + tail, F.slice(ls, head + 1, F.size(ls) - head - tail)).otherwise(F.expr("cast(array() as array<string>)"))
    return F.slice(F.transform(F.filter(mid, lambda x: x.rlike(SEVERE)), lambda x: F.substring(x, 1, LINE_CLIP)), 1, LINES)


def summarize(cells: DataFrame) -> DataFrame:
    """(coll, rows, schema, ranges, values, examples, sample): one row per
    collection; the parts are sorted arrays of structs."""
    pack = lambda d, name, *cols: d.groupBy("coll").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    n = cells.groupBy("coll").agg(F.count_distinct("ord").alias("rows"))
    ranges = cells.where("x is not null").groupBy("coll", "field").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    out = n.join(pack(type_histogram(cells), "schema", "field", "type"), "coll", "left")
    out = out.join(pack(ranges, "ranges", "field", "lo", "hi"), "coll", "left")
    out = out.join(pack(top_value_counts(cells), "values", "field", "value", "n"), "coll", "left")
    out = out.join(pack(examples(cells), "examples", "value", "ord"), "coll", "left")
    return out.join(pack(sample_rows(cells), "sample", "ord"), "coll", "left")
