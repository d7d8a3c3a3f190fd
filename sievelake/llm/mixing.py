"""Mixing sources to target weights by Poisson replication.

Every document draws a count from a Poisson distribution whose mean is its
source's repetition rate; the draw inverts the distribution at a number that a
hash of seed and id gives, so it is the same on every run and partitioning.
Documents are exploded by their counts, and a second hash deals the copies out
and orders them within each partition: a global shuffle without a sort of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import written

#: Terms of the distribution that are summed; a mean may be up to MAX_MEAN,
#: beyond which the tail past the last term would no longer be negligible.
#: Larger means are drawn in independent parts.
TERMS, MAX_MEAN = 96, 32.0


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts' text."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The least k whose cumulative probability exceeds u."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.when(u < F.exp(-mean), 0).otherwise(TERMS).cast("int").alias("k")),
        lambda s, i: F.struct(
            (s["p"] * mean / i).alias("p"),
            (s["c"] + s["p"] * mean / i).alias("c"),
            F.when((s["k"] == TERMS) & (u < s["c"] + s["p"] * mean / i), i).otherwise(s["k"]).alias("k"),
        ),
        lambda s: s["k"],
    )
    return F.when(mean > 0, step).otherwise(F.lit(0))


def poisson_count(mean: Column, seed: int, id_col: Column) -> Column:
    """The count of an id for any mean: up to MAX_MEAN one draw, beyond it the
    sum of draws of equal parts, each with a hash of its own."""
    parts = F.ceil(mean / MAX_MEAN).cast("int")
    more = F.transform(F.sequence(F.lit(1), parts), lambda i: unit_hash(F.lit(f"part{seed}"), i, id_col))
    many = F.aggregate(more, F.lit(0), lambda n, u: n + poisson_inverse(u, mean / parts))
    return F.when(mean > MAX_MEAN, many).otherwise(poisson_inverse(unit_hash(F.lit(seed), id_col), mean))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source", text_col: str = "text", temperature: float = 0.5, budget: float = 1.0) -> DataFrame:
    """(source, weight, rate): the mean number of copies per document.

    ``weights`` has source and weight (any positive scale; a source that it
    lacks gets rate 0). Without it, weights are the sources' shares of code
    points to the power ``temperature``. Over all documents, expected code
    points are ``budget`` times those read. A null source is a source of its
    own. Rates have no upper bound. Sizes are counted over whole texts of all
    rows, combined before the shuffle.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        sized = sizes.withColumn("weight", F.pow("size", F.lit(temperature)))
    else:
        w = weights.select(F.col("source").alias("_sl_source"), "weight")
        sized = sizes.join(w, F.col("source").eqNullSafe(F.col("_sl_source")), "left").select("source", "size", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    total = sized.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    return sized.crossJoin(F.broadcast(total)).select(  # the total is one row
        "source",
        (F.col("weight") / F.col("all_weight")).alias("weight"),
        F.when(F.col("size") > 0, F.lit(budget) * F.col("weight") / F.col("all_weight") * F.col("all_size") / F.col("size")).otherwise(F.lit(0.0)).alias("rate"),
    )


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17, temperature: float = 0.5, budget: float = 1.0) -> DataFrame:
    """All columns of ``docs`` plus copy_no (0 up) and mix_key, the order of the
    global shuffle; rows are dealt out by mix_key and sorted within partitions.

    Repeated rows draw the same count, each keeps it. Null ids hash as empty
    text. Sources whose texts are all empty have rate 0 and go. Columns named
    copy_no or mix_key are replaced. An empty table gives an empty result.
    """
    base = docs.drop("copy_no", "mix_key")
    rates = written(source_rates(base, weights, source_col, text_col, temperature, budget).select(F.col("source").alias("_sl_source"), F.col("rate").alias("_sl_rate")), "rates")
    drawn = base.join(rates, F.col(source_col).eqNullSafe(F.col("_sl_source"))).withColumn(
        "_sl_count", poisson_count(F.col("_sl_rate"), seed, F.col(id_col))
    )
    copies = drawn.where("_sl_count > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("_sl_count") - 1)))
    keyed = copies.withColumn("mix_key", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy_no"))), 1, 15), 16, 10).cast("bigint"))
    names = [F.col(f"`{c}`") for c in base.columns]
    return keyed.select(*names, F.col("copy_no").cast("bigint").alias("copy_no"), "mix_key").repartition("mix_key").sortWithinPartitions("mix_key")
