"""Where entries live: a store is anything that reads and replaces a table."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.operators import store as ST


class StoreBackend(Protocol):
    """What an engine needs of a store."""

    def entries(self) -> DataFrame | None: ...
    def replace(self, entries: DataFrame) -> None: ...


class FolderStore:
    """Parquet snapshots in one folder that the cluster shares. A change writes a
    new snapshot; readers take the latest that Spark has committed, so they never
    see half of one, and the one before stays until the next change."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self):
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(self.folder)
        return where.getFileSystem(sc._jsc.hadoopConfiguration()), sc._jvm.org.apache.hadoop.fs.Path

    def snapshots(self) -> list[int]:
        fs, path = self._files()
        if not fs.exists(path(self.folder)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.folder))]
        done = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def entries(self) -> DataFrame | None:
        known = self.snapshots()
        return self.spark.read.parquet(f"{self.folder}/v{known[-1]}") if known else None

    def replace(self, entries: DataFrame) -> None:
        known = self.snapshots()
        entries.write.parquet(f"{self.folder}/v{known[-1] + 1 if known else 0}")
        fs, path = self._files()
        for old in known[:-1]:
            fs.delete(path(f"{self.folder}/v{old}"), True)


def put(store: StoreBackend, new: DataFrame) -> None:
    """Add entries; of a hash the latest stays."""
    old = store.entries()
    store.replace(new if old is None else ST.put(old, new))


def purge(store: StoreBackend, now: int) -> None:
    old = store.entries()
    if old is not None:
        store.replace(ST.purge(old, now))


def get(store: StoreBackend, hash_key: str, now: int) -> str | None:
    """A live entry's original."""
    old = store.entries()
    if old is None:
        return None
    row = old.where((F.col("hash_key") == hash_key) & ST.live(now)).select("original_content").first()
    return row[0] if row else None
