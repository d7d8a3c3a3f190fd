"""Structured Streaming over event tables: windows, sessions, deduplication and
keyed state. The functions take batch and streaming DataFrames alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.shared import prepare


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the rows of a Parquet table, some files at a time."""
    schema = prepare(spark).read.parquet(path).schema
    if not any(c in path for c in "*?["):  # a stream's source is a pattern: it takes a file as well as a folder
        path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(events: DataFrame, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Event time as a timestamp, with a watermark: state of older windows goes."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def tumbling(events: DataFrame, at: str, size: str, keys: list[str]) -> DataFrame:
    w = F.window(at, size)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,4)")).alias("total")).select(F.unix_timestamp("w.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, at: str, size: str, step: str, keys: list[str]) -> DataFrame:
    w = F.window(at, size, step)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, at: str, gap: str, keys: list[str]) -> DataFrame:
    w = F.session_window(at, gap)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start"), F.unix_timestamp("w.end").alias("end"), *keys, "n")


def hints(events: DataFrame, at: str, keys: list[str], size: str = "600 seconds", step: str = "60 seconds", hint: int = 3, skip: int = 6) -> DataFrame:
    """Retrieval feedback as a sliding window: budget multiplier and skip."""
    s = sliding(events, at, size, step, keys)
    return s.withColumn("multiplier", F.when(F.col("n") >= hint, 1.5).otherwise(1.0)).withColumn("skip", F.col("n") >= skip)


def breaker_states(events: DataFrame, key: str, failed: str, threshold: int = 3) -> DataFrame:
    """Keyed state that windows cannot express: failures in a row per key, and
    how often they reached the threshold, carried from batch to batch."""
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run, opened, seen = state.get if state.exists else (0, 0, 0)
        for f in frames:
            for bad in f.sort_values("event_id")[failed]:
                run = run + 1 if bad else 0
                if run == threshold:
                    opened, run = opened + 1, 0
                seen += 1
        state.update((run, opened, seen))
        yield pd.DataFrame({key: [k[0]], "run": [run], "opened": [opened], "seen": [seen]})

    return events.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, run bigint, opened bigint, seen bigint", "run bigint, opened bigint, seen bigint", "update", "NoTimeout")


def run_complete(stream: DataFrame, folder: str, mode: str = "complete", after: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all data there is and return its last result, which
    every batch writes to a folder of its own."""
    spark = stream.sparkSession
    last: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        (after(batch) if after else batch).write.mode("overwrite").parquet(f"{folder}/out/{number}")
        last.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out/{max(last)}")
