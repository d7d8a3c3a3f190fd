"""What the operators of this subpackage share: the shared work folder, tables
written there, shipping of this package to executors, and connected components.
"""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch that goes to Python. Long documents are common, so
#: this is well below Spark's default of 10,000.
ARROW_ROWS = 250


#: What frees the cache of each operator that keeps one in its Python workers.
_CACHES: dict[str, Callable[[], None]] = {}
_LAST: list[str] = []


def keeps_cache(name: str, clear: Callable[[], None]) -> None:
    _CACHES[name] = clear


def claim_cache(name: str) -> None:
    """Called where a task starts: workers outlive operators, so the caches of
    the others go first, and freed memory goes back to the system."""
    if _LAST != [name]:
        for other, clear in _CACHES.items():
            if other != name:
                clear()
        _LAST[:] = [name]
    give_back()


def give_back() -> None:
    """Return what allocators hold unused; workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ready(spark: SparkSession) -> SparkSession:
    """Ship this package to the Python workers (once per application) and set
    the Arrow batch size for text rows. A union of equally partitioned inputs
    must not pass for partitioned itself: adaptive execution may have merged
    their partitions differently."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    if getattr(sc, "_sievelake_shipped", None) != sc.applicationId:
        root = Path(__file__).resolve().parents[1]
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path(root.name) / p.relative_to(root)))
        out = Path(tempfile.mkdtemp()) / "sievelake_pkg.zip"
        out.write_bytes(buf.getvalue())
        sc.addPyFile(str(out))  # Spark's file server hands it to executors
        sc._sievelake_shipped = sc.applicationId
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder (a URI) under ``spark.checkpoint.dir``, which driver and
    executors share. Where the setting is missing, as in tests, a local folder
    is used, which only a local master may do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        java_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = java_dir.get() if java_dir.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        base = "file://" + os.path.join(tempfile.gettempdir(), "sievelake-work")
    return f"{base.rstrip('/')}/sievelake-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write a table into the shared folder and read it again: this cuts the
    lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sievelake_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table of :func:`written` that no later step reads."""
    path = getattr(df, "_sievelake_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table as (v, label): ``label`` is the
    smallest vertex of v's component.

    Labels go to the neighbours and then along the labels themselves (pointer
    jumping), so rounds grow with the logarithm of the diameter. Each round is
    written to the shared folder; vertices without edges aren't returned.
    Aggregation combines before the shuffle, and joins are plain equi-joins of
    written tables, whose hot keys Spark splits.
    """
    both = written(
        edges.select(F.col(a).alias("v"), F.col(b).alias("u"))
        .unionByName(edges.select(F.col(b).alias("v"), F.col(a).alias("u")))
        .where("v != u"),
        "edges",
    )
    labels = written(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("near"))
        moved = written(labels.join(near, "v").select("v", F.least("label", "near").alias("label"), F.col("label").alias("was")), "labels")
        up = moved.select(F.col("v").alias("label"), F.col("label").alias("up"))
        nxt = written(moved.join(up, "label").select("v", F.least("label", "up").alias("label"), "was"), "labels")
        changed = nxt.where("label != was").limit(1).count()
        drop_written(labels)
        drop_written(moved)
        labels = nxt
        if not changed:
            drop_written(both)
            return labels.select("v", "label")
    raise RuntimeError("components did not settle; raise max_rounds")
