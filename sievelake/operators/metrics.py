"""Quality of a reduction: savings, retention, recovery and its price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of one retrieval call around its payload. Fixed value.
CALL_TOKENS = 106


def savings(before: Column, after: Column) -> Column:
    return F.when(before > 0, (before - after) / before).otherwise(F.lit(0.0))


def by_dataset(rows: DataFrame, kept: DataFrame, stored: DataFrame, dataset: str, key: str, tokens: str) -> DataFrame:
    """(dataset, rows, tokens_before, tokens_after, reduction, dropped_ratio,
    retention): ``kept`` and ``stored`` hold the keys that are visible and that
    can be restored; retention is the share of distinct rows in either."""
    r = rows.select(F.col(dataset).alias("dataset"), F.col(key).alias("key"), F.col(tokens).alias("tokens"))
    flag = lambda d, n: d.select(F.col(key).alias("key")).distinct().withColumn(n, F.lit(True))
    j = r.join(flag(kept, "seen"), "key", "left").join(flag(stored, "safe"), "key", "left")
    seen, safe = F.coalesce("seen", F.lit(False)), F.coalesce("safe", F.lit(False))
    g = j.groupBy("dataset").agg(
        F.count("*").alias("rows"), F.sum("tokens").alias("tokens_before"), F.sum(F.when(seen, F.col("tokens")).otherwise(0)).alias("tokens_after"),
        F.avg((~seen).cast("double")).alias("dropped_ratio"), F.avg((seen | safe).cast("double")).alias("retention"),
    )
    return g.withColumn("reduction", savings(F.col("tokens_before"), F.col("tokens_after")))


def effective(before: Column, after: Column, payload: Column, blobs: Column, rate: float) -> Column:
    """Savings once a share of readers retrieves: any retrieval brings the whole
    payload back, and each stored blob costs a call."""
    cost = payload + blobs * CALL_TOKENS if rate > 0 else F.lit(0)
    return savings(before, after + cost)


def opaque(before: Column, after: Column, payload: Column) -> Column:
    """Net tokens of a whole-blob offload if it is retrieved once."""
    return before - after - payload - CALL_TOKENS


def net_gain(saved: Column, suffix: Column, cached_rate: float = 0.1) -> Column:
    """Tokens saved less what re-billing the cached suffix costs; null if the
    suffix is unknown."""
    return saved.cast("double") - suffix.cast("double") * (1.0 - cached_rate)


def suffix_tokens(messages: DataFrame, conv: str, turn: str, tokens: str) -> DataFrame:
    """Adds tokens_after: the tokens of later messages of the conversation."""
    from pyspark.sql import Window

    w = Window.partitionBy(conv).orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("tokens_after", F.coalesce(F.sum(tokens).over(w), F.lit(0)))


def multiset_hash(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, rows, digest): equal for equal multisets of texts. Digests of rows
    are summed as numbers, so no list is built and no order is needed."""
    h = F.sha2(F.coalesce(F.col(text), F.lit("\0")), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 13 * i, 13), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.concat_ws("-", part(0), part(1), part(2), part(3)).alias("digest"))


def regression(run: DataFrame, baseline: DataFrame, key: str, value: str, tolerance: float = 0.02) -> DataFrame:
    """(key, now, floor, verdict): a run against a baseline; what only one of
    them has is new or missing."""
    a = run.select(key, F.col(value).alias("now"))
    b = baseline.select(key, F.col(value).alias("floor"))
    verdict = F.when(F.col("floor").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("now") < F.col("floor") - tolerance, "regressed").otherwise("ok")
    return a.join(b, key, "full").select(key, "now", "floor", verdict.alias("verdict"))
