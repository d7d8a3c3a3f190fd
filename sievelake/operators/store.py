"""The store of originals: a table keyed by content hash.

Puts, purges and evictions are rewrites of the table; reads are filters. Rows
have created_at and ttl in seconds, a namespace and counters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_TTL, MEMORY_ROWS, DURABLE_ROWS = 1800, 1000, 10_000


def live(now: Column | int) -> Column:
    """Whether an entry's time to live has not run out."""
    return F.lit(now) - F.col("created_at") <= F.col("ttl")


def purge(entries: DataFrame, now: int) -> DataFrame:
    return entries.where(live(now))


def put(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with the new ones, the latest of each hash."""
    both = entries.unionByName(new)
    w = Window.partitionBy("hash_key").orderBy(F.desc("created_at"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def evict(entries: DataFrame, capacity: int, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, evicted): the newest ``capacity`` entries and the rest, ties by
    hash; per namespace when ``by`` names its column. Without namespaces the
    cut is found as a bounded top-k, not by ranking all rows in one task."""
    if by is None:
        edge = entries.select("created_at", "hash_key").orderBy(F.desc("created_at"), "hash_key").limit(capacity).agg(F.min("created_at").alias("c"), F.count("*").alias("k"), F.max_by("hash_key", F.struct(-F.col("created_at"), F.col("hash_key"))).alias("h"))
        j = entries.crossJoin(F.broadcast(edge))  # one row
        inside = (F.col("created_at") > F.col("c")) | ((F.col("created_at") == F.col("c")) & (F.col("hash_key") <= F.col("h")))
        return j.where(inside).drop("c", "k", "h"), j.where(~inside).drop("c", "k", "h")
    w = Window.partitionBy(by).orderBy(F.desc("created_at"), "hash_key")
    r = entries.withColumn("_r", F.row_number().over(w))
    return r.where(F.col("_r") <= capacity).drop("_r"), r.where(F.col("_r") > capacity).drop("_r")


def read_through(keys: DataFrame, fast: DataFrame, spilled: DataFrame) -> DataFrame:
    """(hash_key, tier, original_content): from the fast tier, else the spilled
    one; tier is null for a miss."""
    a = fast.select("hash_key", F.col("original_content").alias("a"))
    b = spilled.select("hash_key", F.col("original_content").alias("b"))
    j = keys.select("hash_key").join(a, "hash_key", "left").join(b, "hash_key", "left")
    return j.select("hash_key", F.when(F.col("a").isNotNull(), "fast").when(F.col("b").isNotNull(), "spill").alias("tier"), F.coalesce("a", "b").alias("original_content"))


def stats(entries: DataFrame, now: int, capacity: int) -> DataFrame:
    return entries.where(live(now)).agg(
        F.count("*").alias("entries"), F.sum("original_tokens").alias("original_tokens"), F.sum("compressed_tokens").alias("compressed_tokens"),
        F.sum("retrieval_count").alias("retrievals"), (F.count("*") / F.lit(capacity)).alias("fill"),
    )


def counters(events: DataFrame, name: str, amount: str) -> DataFrame:
    return events.groupBy(F.col(name).alias("name")).agg(F.sum(amount).alias("value"))


def access_log(events: DataFrame, key: str, at: str, query: str, last: int = 10) -> DataFrame:
    """(key, retrieval_count, last_accessed, search_queries): the last ten
    queries of each entry, oldest first. They are picked by rank, so no list
    longer than ten is built."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(query))
    total = events.groupBy(key).agg(F.count("*").alias("retrieval_count"), F.max(at).alias("last_accessed"))
    tail = events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("o"), F.col(query).alias("q")))), lambda x: x["q"]).alias("search_queries"))
    return total.join(tail, key)


def feedback(events: DataFrame, shape: list[str], at: str, window: int = 600, hint: int = 3, skip: int = 6, most: int = 64) -> DataFrame:
    """Adds in_window (retrievals of the shape in the last ``window`` seconds, at
    most 64), multiplier and skip: from 3 on the budget is half as much again,
    from 6 on nothing is reduced."""
    w = Window.partitionBy(*shape).orderBy(at).rangeBetween(-window + 1, 0)
    n = F.least(F.count("*").over(w), F.lit(most))
    return events.withColumn("in_window", n).withColumn("multiplier", F.when(F.col("in_window") >= hint, 1.5).otherwise(1.0)).withColumn("skip", F.col("in_window") >= skip)


def breaker(events: DataFrame, key: str, at: str, failed: str, threshold: int = 3, cooldown: int = 60) -> DataFrame:
    """(key, at, state): a circuit breaker per key. Three failures in a row open
    it for 60 seconds; calls meanwhile are refused and don't count. State after
    state is sequential, so it is a fold over each key's calls in order."""
    calls = F.sort_array(F.collect_list(F.struct(F.col(at).alias("t"), F.col(failed).alias("f"))))
    zero = F.struct(F.lit(0).alias("run"), F.lit(-(10**12)).cast("bigint").alias("until"), F.expr("cast(array() as array<struct<t: bigint, s: string>>)").alias("out"))

    def step(a, x):
        t, blocked = x["t"].cast("bigint"), x["t"] < a["until"]
        run = F.when(blocked, a["run"]).when(x["f"], a["run"] + 1).otherwise(0)
        opens = ~blocked & (run >= threshold)
        s = F.when(blocked, "refused").when(opens, "opened").when(x["f"], "failed").otherwise("ok")
        return F.struct(
            F.when(opens, 0).otherwise(run).alias("run"),
            F.when(opens, t + cooldown).otherwise(a["until"]).cast("bigint").alias("until"),
            F.concat(a["out"], F.array(F.struct(t.alias("t"), s.alias("s")))).alias("out"),
        )

    folded = events.groupBy(key).agg(F.aggregate(calls, zero, step).alias("a"))
    return folded.select(key, F.explode("a.out").alias("o")).select(key, F.col("o.t").alias(at), F.col("o.s").alias("state"))


def frozen_prefix(messages: DataFrame, conv: str, turn: str, marked: Column) -> DataFrame:
    """Adds ``frozen``: up to the last message of a conversation that carries a
    cache marker, nothing may change."""
    edge = F.max(F.when(marked, F.col(turn))).over(Window.partitionBy(conv))
    return messages.withColumn("frozen", F.coalesce(F.col(turn) <= edge, F.lit(False)))


def prefix_hashes(messages: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """(conv, turn, hash, changed): a running hash over the texts so far, each
    framed by its length, and whether the message's own text differs from the
    one before."""
    w = Window.partitionBy(conv).orderBy(turn)
    framed = F.sha2(F.concat(F.length(text).cast("string"), F.lit(":"), F.col(text)), 256)
    seen = F.array_join(F.collect_list(framed).over(w.rowsBetween(Window.unboundedPreceding, 0)), "")
    return messages.select(conv, turn, F.sha2(seen, 256).alias("hash"), F.coalesce(framed != F.lag(framed).over(w), F.lit(True)).alias("changed"))


def budget_ladder(sizes: DataFrame, key: list[str], rung: str, size: str, most: Column | int) -> DataFrame:
    """(key, rung, size, fits): the mildest rung that fits, else the smallest."""
    fits = F.col(size) <= F.lit(most)
    w = Window.partitionBy(*key).orderBy(F.desc(fits), F.when(fits, F.col(rung)), size, rung)
    return sizes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*key, rung, size, fits.alias("fits"))


def result_cache(requests: DataFrame, key: list[str], at: str, ttl: int = 1800, tie: str | None = None) -> DataFrame:
    """Adds ``hit``: an equal request came within the last ``ttl`` seconds. Of
    requests at the same second the one with the least ``tie`` is the earliest."""
    w = Window.partitionBy(*key).orderBy(at, *([tie] if tie else []))
    return requests.withColumn("hit", F.coalesce(F.col(at) - F.lag(at).over(w) <= ttl, F.lit(False)))
