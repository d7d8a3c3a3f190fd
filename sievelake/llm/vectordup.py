"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are picked from a bounded sample by farthest-first
traversal. A vector is described by its ``PREFIX`` nearest pivots in order. The
inverted lists are those of pairs of pivots: a vector is posted in the list of
each two of its prefix, so that two vectors meet exactly when they share
``SHARED`` = 2 pivots or more, and lists shorten with the square of the pivots
that a neighbourhood has. The cosine in double precision then decides. A pair is
judged only in the list of the two smallest pivots that both share, so each link
counts once.

Equal vectors form a class with one row, named by its digest. Lists longer than
``BLOCK`` are split into blocks, and a task gets two blocks, never a whole list.
A task returns one row per linked vector (its links, and the first vector of its
local group), never the pairs.

Pivots are as many as the square root of the number of classes, within
[MIN_PIVOTS, MAX_PIVOTS].
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import components, drop_written, ready, written

PREFIX, SHARED, BLOCK = 5, 2, 2000
MIN_PIVOTS, MAX_PIVOTS, SAMPLE_PER_PIVOT = 32, 1024, 8


def unit_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, dim, unit, sig): unit is the vector over its norm as float64
    bytes, sig a digest of the vector itself; both null for vectors that are
    null, empty, zero or hold null or non-finite components."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, unit, sig = [], [], []
            for v in batch.column(1).to_pylist():
                x = None if v is None or None in v else np.array(v, np.float64) + 0.0
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    dim.append(None), unit.append(None), sig.append(None)
                    continue
                y = x / np.abs(x).max()  # so that squares neither overflow nor vanish
                dim.append(len(x))
                unit.append((y / np.sqrt((y * y).sum())).tobytes())
                sig.append(hashlib.md5(x.tobytes()).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dim, pa.int32()), pa.array(unit, pa.binary()), pa.array(sig, pa.binary())], ["vec_id", "dim", "unit", "sig"])

    return rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(prepare, "vec_id bigint, dim int, unit binary, sig binary")


def choose_pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """Pivots per dimension from the SAMPLE_PER_PIVOT * pivots classes with the
    smallest hashes; at most 8 * 1024 vectors come to the driver."""
    n = classes.count()
    pivots = min(MAX_PIVOTS, max(MIN_PIVOTS, math.isqrt(max(n, 1))))
    sample = classes.orderBy(F.xxhash64("sig"), "sig").limit(pivots * SAMPLE_PER_PIVOT).select("unit").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r[0]) // 8, []).append(np.frombuffer(r[0], np.float64))
    out = {}
    for dim, rows in by_dim.items():
        x = np.array(rows)
        chosen, near = [0], x @ x[0]
        while len(chosen) < min(pivots, len(x)):
            i = int(near.argmin())
            if near[i] > 0.999:  # only copies of pivots are left
                break
            chosen.append(i)
            near = np.maximum(near, x @ x[i])
        out[dim] = x[chosen]
    return out


def post(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Inverted lists: (dim, p, q, sig, cnt, perm, unit), a row for each two
    pivots p < q of a class's prefix. Where there is one pivot only, or none as
    the sample lacks the dimension, all vectors share one list (p, q are 0) and
    are all compared."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(pivots)  # at most MAX_PIVOTS vectors a dimension

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            sigs, dims, units, cnts = (c.to_pylist() for c in batch.columns)
            for d in sorted(set(dims)):
                at = [i for i, x in enumerate(dims) if x == d]
                x = np.frombuffer(b"".join(units[i] for i in at), np.float64).reshape(len(at), d)
                p = shared.value.get(d)
                near = np.zeros((len(at), 1), np.int16) if p is None else np.argsort(-(x @ p.T), 1, kind="stable")[:, :PREFIX].astype(np.int16)
                for i, perm in zip(at, np.sort(near, 1)):
                    for a, b in combinations(perm.tolist(), 2) if len(perm) > 1 else [(0, 0)]:
                        for col, value in zip(out, (d, a, b, sigs[i], cnts[i], perm.tobytes(), units[i])):
                            col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary()))], ["dim", "p", "q", "sig", "cnt", "perm", "unit"])

    return classes.select("sig", "dim", "unit", "cnt").mapInArrow(lists, "dim int, p int, q int, sig binary, cnt bigint, perm binary, unit binary")


def _links(threshold: float):
    none = pa.table({"sig": pa.array([], pa.binary()), "links": pa.array([], pa.int64()), "hub": pa.array([], pa.binary())})

    def judge(table: pa.Table) -> pa.Table:
        if len(table) < 2:
            return none
        dim, p, q, i, j = (table[c][0].as_py() for c in ("dim", "p", "q", "bi", "bj"))
        sig, block = table["sig"].to_pylist(), table["block"].to_numpy()
        order = sorted(range(len(sig)), key=lambda k: (block[k], sig[k]))
        sig, cnt, block = [sig[k] for k in order], table["cnt"].to_numpy()[order], block[order]
        x = np.frombuffer(b"".join(table["unit"].take(pa.array(order)).to_pylist()), np.float64).reshape(len(sig), dim)
        perms = np.frombuffer(b"".join(table["perm"].take(pa.array(order)).to_pylist()), np.int16).reshape(len(sig), -1)
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        names, at = np.unique(perms, return_inverse=True)
        early = np.zeros((len(sig), len(names)), np.float32)  # pivots that make an earlier list with p
        early[np.arange(len(sig))[:, None], at.reshape(perms.shape)] = 1
        early[:, (names >= q) | (names == p)] = 0
        links = np.zeros(len(sig), np.int64)
        edges = []
        for lo in range(0, len(left), 512):
            part = left[lo : lo + 512]
            with np.errstate(all="ignore"):
                good = early[part] @ early[right].T == 0
                if i == j:
                    good &= part[:, None] < right[None, :]
                if not good.any():  # these meet in an earlier list, like most of a dense group
                    continue
                good &= x[part] @ x[right].T >= threshold
            a, b = np.nonzero(good)
            if len(a):
                a, b = part[a], right[b]
                links += np.bincount(a, cnt[b], len(sig)).astype(np.int64) + np.bincount(b, cnt[a], len(sig)).astype(np.int64)
                edges.append((a, b))
        label = np.arange(len(sig))
        if edges:
            a, b = (np.concatenate(e) for e in zip(*edges))
            while True:  # the first row that is reached
                new = label.copy()
                np.minimum.at(new, a, label[b])
                np.minimum.at(new, b, label[a])
                new = np.minimum(new, new[new])
                if (new == label).all():
                    break
                label = new
        some = np.flatnonzero(links)
        return pa.table({"sig": pa.array([sig[k] for k in some], pa.binary()), "links": pa.array(links[some], pa.int64()), "hub": pa.array([sig[k] for k in label[some]], pa.binary())})

    return judge


def near_duplicate_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept.

    Vectors with a cosine of ``threshold`` or more are linked, whatever else the
    rows hold. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing; so do vectors of different dimensions.
    n_links counts other rows linked directly, equal vectors among them.
    component_id is the smallest id reachable. Ids may be null, which counts as
    no id but as a row, or repeated with any vectors: links join vectors, not
    ids. A component without any id has component_id null; kept is null for a
    null id. Ids are integers (others are cast). An empty table gives no rows.
    """
    ready(rows.sparkSession)
    units = written(unit_vectors(rows, id_col, vec_col), "units")
    classes = written(units.where("sig is not null").groupBy("sig", "dim").agg(F.min("vec_id").alias("least"), F.count("*").alias("cnt"), F.first("unit").alias("unit")), "classes")
    lists = written(post(classes, choose_pivots(classes)), "lists")
    # Fewer rows than MAX_PIVOTS**2 / 2 a dimension and than all postings over BLOCK: 16 MB at most.
    long = lists.groupBy("dim", "p", "q").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    dealt = (
        lists.join(F.broadcast(long), ["dim", "p", "q"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("dim", "p", "q", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "sig", "cnt", "perm", "unit")
    )
    found = written(dealt.groupBy("dim", "p", "q", "bi", "bj").applyInArrow(_links(threshold), "sig binary, links bigint, hub binary"), "found")
    labels = components(found.select(F.col("sig").alias("a"), F.col("hub").alias("b")))
    links = found.groupBy("sig").agg(F.sum("links").alias("links"))
    member = written(
        classes.select("sig", "least", "cnt")
        .join(links, "sig", "left")
        .join(labels.select(F.col("v").alias("sig"), "label"), "sig", "left")
        .select("sig", "least", F.coalesce("label", "sig").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("n_links")),
        "member",
    )
    named = member.groupBy("label").agg(F.min("least").alias("component_id"))
    class_of = written(member.join(named, "label").select("sig", "n_links", "component_id"), "class_of")
    for done in (lists, found, member):
        drop_written(done)
    component = F.when(F.col("sig").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return (
        units.select("vec_id", "sig")
        .join(class_of, "sig", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
