"""Record collections: rows that belong to one collection and have an order.

Operators never rely on the order in which Spark happens to read rows: every
collection has an explicit ``ord``. The long form has one row per cell, which
lets one plan serve any set of columns: (coll, ord, field, kind, s, x) with the
value's kind, its text and, for finite numbers, its value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.shared import prepare

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def with_ord(df: DataFrame, coll: str, *order: str) -> DataFrame:
    """Add ``ord``: 0, 1, ... within each collection in the given order. The
    order must be total, so it should end with a unique key."""
    return df.withColumn("ord", F.row_number().over(Window.partitionBy(coll).orderBy(*order)) - 1)


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, NUMERIC):
        return "numeric"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    return "string"


def text_of(c: Column, t: T.DataType) -> Column:
    """A value's text: booleans as True/False, containers as JSON."""
    if isinstance(t, T.BooleanType):
        return F.when(c, "True").otherwise(F.when(~c, "False"))
    if isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def cells(df: DataFrame, coll: str, fields: list[str], ord: str = "ord") -> DataFrame:
    """The long form of the given columns; nulls are cells of kind null."""
    parts = []
    for f in fields:
        t, c = df.schema[f].dataType, F.col(f)
        kind = kind_of(t)
        x = c.cast("double") if kind == "numeric" else F.lit(None).cast("double")
        x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        parts.append(
            F.struct(
                F.lit(f).alias("field"),
                F.when(c.isNull(), "null").otherwise(kind).alias("kind"),
                text_of(c, t).alias("s"),
                x.alias("x"),
            )
        )
    return df.select(F.col(coll).alias("coll"), F.col(ord).alias("ord"), F.explode(F.array(*parts)).alias("c")).select("coll", "ord", "c.*")
