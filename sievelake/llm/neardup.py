"""Near-duplicate documents by SetSketch registers.

A document is its set of distinct k-word shingles. A sketch holds, for each of
512 hash functions, the exponentially spaced and truncated minimum over the
set: registers are mergeable (the sketch of a union is the maximum) and two
sets share a register with a probability that grows with their similarity.

1. Equal sets form a class with a number of its own, so copies cost one row.
2. Eight registers make a band; classes that share a band meet. Within a band's
   bucket each class is paired with the smallest, not with all others.
3. Registers of a pair, given the known set sizes, have a likelihood in the
   similarity; pairs that it rules out at five deviations go.
4. The rest is confirmed on full sets. A task passes over pairs whose ends its
   links join already. Components follow from one link of each document, fewer
   links than documents however many bands near copies share; the other links
   count between those components only.
5. Buckets that still hold several components are looked at again, with the full
   sets of their members: between two components, the pairs that the likelihood
   allows are confirmed in the order of their estimates until one is a link.
   Two components need one link only, and only links leave a task. Members of a
   bucket's largest component are compared with the others only, so a bucket
   costs its size times the blocks of those others.

A pair of similarity 0.8 shares no band with a probability of 8e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import claim_cache, components, drop_written, give_back, keeps_cache, ready, written

REGISTERS, BAND, BASE = 512, 8, 1.1
BANDS = REGISTERS // BAND
#: A pair is dropped unverified only if the threshold's log-likelihood falls
#: this far below the best one: five standard deviations.
RULED_OUT = 12.5

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_rng = np.random.default_rng(20240613)
_MUL = (_rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)[:, None]
_BAND_SEED = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


class _WordHash(dict):
    """Word hashes of a worker; it stops growing at a size, which only costs time."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 400_000:
            self[word] = h
        return h


_WORDS = _WordHash()
keeps_cache("neardup", _WORDS.clear)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _K2
    h = (h ^ (h >> np.uint64(29))) * _K3
    return h ^ (h >> np.uint64(32))


def shingles(raw: bytes | None, width: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text,
    A-Z in lower case; with fewer words, one of the whole sequence."""
    words = (raw or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    x = np.full(len(h) - k + 1, np.uint64(k) * _K3)
    for i in range(k):
        x = _mix((x + h[i : len(h) - k + 1 + i]) * _K1)
    return np.unique(x)


def registers(x: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint8) of a set of hashes."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    small = (x >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(small), 256):
        np.minimum(low, (_MUL * small[None, i : i + 256] + _ADD).min(1), out=low)
    value = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(33 - np.log(value) / np.log(BASE)), 0, 255).astype(np.uint8)


def similarity_likelihood(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Joint estimate of the Jaccard similarity of rows of registers, and how far
    the threshold's log-likelihood falls below the best (0 at or above it)."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = REGISTERS - more - less
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)[None, :] * top[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j: np.ndarray) -> np.ndarray:
        pm, pl = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
        logs = [np.log(np.maximum(q, 1e-12)) for q in (pm, pl, 1 - pm - pl)]
        return more[:, None] * logs[0] + less[:, None] * logs[1] + same[:, None] * logs[2]

    each = value(grid)
    best = grid[np.arange(len(a)), each.argmax(1)]
    short = each.max(1) - value(np.minimum(threshold, top)[:, None])[:, 0]
    return best, np.where(best >= threshold, 0.0, short)


def likelihood_in_parts(regs: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, rows: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """:func:`similarity_likelihood` of the rows a and b, a few at a time."""
    parts = [similarity_likelihood(regs[a[k : k + rows]], regs[b[k : k + rows]], n[a[k : k + rows]], n[b[k : k + rows]], threshold) for k in range(0, len(a), rows)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def sketch_documents(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, n, sig, regs) of every row; sig is a 128-bit digest of the set,
    null for an empty one."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache("neardup")
        for batch in batches:
            n, sig, regs, known = [], [], [], {}
            for raw in batch.column(1).to_pylist():
                x = shingles(raw, width)
                n.append(len(x))
                key = hashlib.md5(x.tobytes()).digest() if len(x) else None
                if key is not None and key not in known:
                    known[key] = registers(x).tobytes()
                sig.append(key)
                regs.append(known.get(key))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n", "sig", "regs"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    return rows.mapInArrow(sketch, "doc_id bigint, n bigint, sig binary, regs binary")


def _bands(classes: DataFrame) -> DataFrame:
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        _WORDS.clear()  # sketches are done
        for batch in batches:
            rows = len(batch)
            if not rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(rows, BANDS)
            keys = _mix((regs ^ _BAND_SEED[None, :]) * _K1).view(np.int64).ravel()
            rep, n = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), BANDS) for i in (0, 1))
            band = np.tile(np.arange(BANDS, dtype=np.int32), rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(band), pa.array(rep), pa.array(n)], ["key", "band", "rep", "n"])

    return classes.select("rep", "n", "regs").mapInArrow(explode, "key bigint, band int, rep bigint, n bigint")


def _plausible(na: np.ndarray, nb: np.ndarray, same: np.ndarray, threshold: float) -> np.ndarray:
    """A quick test by equal registers alone, at six deviations: pairs it drops
    the joint likelihood would drop, too."""
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    equal = np.clip(1 - p(u - v * threshold) - p(v - u * threshold), 1e-6, 1)
    return same >= REGISTERS * equal - 6 * np.sqrt(REGISTERS * equal * (1 - equal)) - 1


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and registers allow to reach the threshold."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, REGISTERS) for i in (2, 3))
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (4, 5))
            _, short = similarity_likelihood(ra, rb, na, nb, percent / 100)
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["a", "b"]).filter(pa.array(short <= RULED_OUT))

    return written(
        pairs.join(side("a"), "a").join(side("b"), "b")
        .where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        .select("a", "b", "ra", "rb", "na", "nb")
        .mapInArrow(likely, "a bigint, b bigint"),
        "likely",
    )


#: Ids of documents to look up that are sent to all tasks at most: 8 bytes each.
#: Beyond, texts and ids are joined by a shuffle.
LOOKUP_IDS = 2_000_000


def _sets(reps: DataFrame, classes: DataFrame, docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(v, set): the full sets of representatives, sorted hashes as bytes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache("neardup")
        for batch in batches:
            full = [shingles(raw, width).tobytes() for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(full, pa.binary())], ["v", "set"])

    wanted = written(classes.join(reps.distinct(), classes["rep"] == F.col("v"), "left_semi").select("rep", "least", "sig"), "wanted")
    ids = wanted.select(F.col("least").alias("v")).distinct()
    texts = docs.select(F.col(id_col).cast("bigint").alias("v"), F.col(text_col).cast("binary").alias("raw"))
    looked_up = F.broadcast(ids) if wanted.count() <= LOOKUP_IDS else ids
    # An id may be repeated with another text: only the class's own set counts.
    full = texts.join(looked_up, "v", "left_semi").mapInArrow(sets, "v bigint, set binary").withColumn("sig", F.unhex(F.md5("set")))
    out = written(full.join(wanted.select("rep", "sig"), "sig").groupBy("rep").agg(F.first("set").alias("set")).withColumnRenamed("rep", "v"), "sets")
    drop_written(wanted)
    return out


def _root(parent: dict[int, int], v: int) -> int:
    """The root of v in a forest, where a vertex without a parent is one."""
    while (up := parent.get(v, v)) != v:
        parent[v] = v = parent.get(up, up)
    return v


def _confirmed(left: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Of the pairs (a, b) of representatives whose full sets reach the threshold,
    a forest of each task's: what it leaves out joins nothing further."""

    full = _sets(left.select(F.col("a").alias("v")).unionByName(left.select(F.col("b").alias("v"))), classes, docs, width, id_col, text_col)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        for batch in batches:
            good = []
            for a, b, x, y in zip(*(column.to_pylist() for column in batch.columns)):
                p, q = _root(parent, a), _root(parent, b)
                good.append(p != q and _reaches(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
                if good[-1]:
                    parent[p] = q
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["a", "b"]).filter(pa.array(good, pa.bool_()))

    part = lambda x, s: full.select(F.col("v").alias(x), F.col("set").alias(s))
    out = written(left.join(part("a", "x"), "a").join(part("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint"), "links")
    drop_written(full)
    return out


#: Members of a bucket, and shingles of all of them, that a task compares with as
#: many others; larger buckets are split into blocks, and a task gets two.
BLOCK, BLOCK_SHINGLES = 2000, 8_000_000


def _reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _between(percent: int):
    """For a block of a bucket's others (outside its largest component) and a
    block of all members: links between components, at most one between two of
    them, by the best estimates first. A pair is looked at in the first band that
    it shares only, and of two others by the first of them."""

    def choose(table: pa.Table) -> pa.Table:
        i, j, band = (table[c][0].as_py() for c in ("bi", "bj", "band"))
        rep, label, n, other, block = (table[c].to_numpy(zero_copy_only=False) for c in ("rep", "label", "n", "other", "block"))
        order = np.lexsort((rep, label))
        rep, label, n, other, block = rep[order], label[order], n[order].astype(np.float64), other[order], block[order]
        regs = np.frombuffer(b"".join(table["regs"].take(pa.array(order)).to_pylist()), np.uint8).reshape(-1, REGISTERS)
        bands = regs.view(np.uint64)
        group = np.unique(label, return_inverse=True)[1]
        rows, partners = np.flatnonzero(other == i), np.flatnonzero(block == j)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for lo in range(0, len(rows), 32):
            part = rows[lo : lo + 32]
            # Each pair once: against the largest component, and others behind.
            ok = (group[part][:, None] != group[None, partners]) & ((other[partners] < 0)[None, :] | (rep[None, partners] > rep[part][:, None]))
            ok &= 100 * np.minimum(n[part][:, None], n[None, partners]) >= percent * np.maximum(n[part][:, None], n[None, partners])
            a, b = np.nonzero(ok)
            a, b = part[a], partners[b]
            for k in range(0, len(a), 20_000):
                x, y = a[k : k + 20_000], b[k : k + 20_000]
                first = (bands[x] == bands[y]).argmax(1) == band
                x, y = x[first], y[first]
                keep = _plausible(n[x], n[y], (regs[x] == regs[y]).sum(1), percent / 100)
                if keep.any():
                    found.append((x[keep], y[keep]))
        links = []
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            best, short = likelihood_in_parts(regs, n, a, b, percent / 100)
            good = np.flatnonzero(short <= RULED_OUT)
            good = good[np.lexsort((b[good], a[good], -best[good]))]
            column = table["set"].take(pa.array(order))
            parent: dict[int, int] = {}
            sets: dict[int, np.ndarray] = {}
            for x, y in zip(a[good].tolist(), b[good].tolist()):
                p, q = _root(parent, int(group[x])), _root(parent, int(group[y]))
                if p == q:
                    continue
                for z in (x, y):
                    if z not in sets:
                        sets[z] = np.frombuffer(column[z].as_py(), np.uint64)
                if _reaches(sets[x], sets[y], percent):
                    parent[p] = q
                    links.append((int(rep[x]), int(rep[y])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return choose


def _mixed(met: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, band, rep, n, label) of buckets with more than one component,
    with the largest one's label and how many blocks all members and those
    outside it make."""
    placed = written(met.join(labels.select(F.col("v").alias("rep"), "label"), "rep", "left").select("key", "band", "rep", "n", F.coalesce("label", "rep").alias("label")), "placed")
    parts = placed.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    largest = F.max(F.struct("m", "s", "label"))
    blocks = lambda m, s: F.ceil(F.greatest(m / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    several = (
        parts.groupBy("key")
        .agg(F.count("*").alias("k"), F.sum("m").alias("m"), F.sum("s").alias("s"), largest.alias("top"))
        .where("k > 1")
        .select("key", F.col("top.label").alias("main"), blocks(F.col("m"), F.col("s")).alias("blocks"), blocks(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("others"))
    )
    out = written(placed.join(several, "key"), "mixed")
    drop_written(placed)
    return out


def _links_between(mixed: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    full = _sets(mixed.select(F.col("rep").alias("v")), classes, docs, width, id_col, text_col)
    members = written(full.select(F.col("v").alias("rep"), "set").join(classes.select("rep", "regs"), "rep"), "members")
    part = lambda k: F.pmod(F.xxhash64("rep"), F.col(k)).cast("int")
    is_other = F.col("label") != F.col("main")
    row = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda i: F.struct(i.alias("bi"), F.col("block").alias("bj")))
    column = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.col("other").alias("bi"), j.alias("bj")))
    dealt = (
        mixed.withColumn("block", part("blocks"))
        .withColumn("other", F.when(is_other, part("others")).otherwise(-1))
        .withColumn("at", F.explode(F.when(is_other, F.array_union(row, column)).otherwise(row)))
        .select("key", "at.bi", "at.bj", "band", "block", "other", "rep", "n", "label")
        .join(members, "rep")
    )
    out = written(dealt.groupBy("key", "bi", "bj").applyInArrow(_between(percent), "a bigint, b bigint"), "between")
    drop_written(full)
    drop_written(members)
    return out


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (v, label) of components after further links (a, b), found on
    the components' names alone."""
    name = lambda x: labels.select(F.col("v").alias(x), F.col("label").alias(f"of_{x}"))
    ends = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    up = components(ends.where("a != b").distinct())
    named = labels.join(up.select(F.col("v").alias("label"), F.col("label").alias("up")), "label", "left").select("v", F.coalesce("up", "label").alias("label"))
    # A component's name is one of its vertices: others had no link before.
    return written(named.unionByName(up.join(labels.select("v"), "v", "left_anti")), "joined")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept.

    Documents are linked when 100 * intersection >= percent * union of their
    sets of ``width``-word shingles. component_id is the smallest id reachable
    and kept says whether it is the row's own. A null text or one without words
    has an empty set, is linked with nothing and is kept. Repeated rows are in
    one component, and an id that is repeated with other texts names each of
    them. A row with a null id takes part only through others' ids and has kept
    null; ids are integers (others are cast). Other columns are ignored; an
    empty table gives no rows.
    """
    ready(docs.sparkSession)
    sketches = written(sketch_documents(docs, id_col, text_col, width), "sketches")
    classes = written(  # written with their numbers, which stay the same from here on
        sketches.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("regs").alias("regs")).withColumn("rep", F.monotonically_increasing_id()),
        "classes",
    )
    bands = _bands(classes)
    # Only buckets of two or more are kept: few rows.
    several = bands.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least != most").drop("most")
    met = written(bands.join(several, "key"), "met")
    stars = met.where("rep != least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    links = _confirmed(_likely(stars, classes, percent), classes, docs, width, percent, id_col, text_col)
    labels = _joined(components(links.groupBy("b").agg(F.min("a").alias("a"))), links)
    mixed = _mixed(met, labels)
    if mixed.limit(1).count():
        more = _links_between(mixed, classes, docs, width, percent, id_col, text_col)
        if more.limit(1).count():
            labels = _joined(labels, more)
    member = classes.select("sig", "least", "rep").join(labels.select(F.col("v").alias("rep"), "label"), "rep", "left").select("sig", "least", F.coalesce("label", "rep").alias("label"))
    member = written(member, "member")
    class_of = written(member.join(member.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("sig", "component_id"), "class_of")
    for done in (met, mixed, links, labels, member):
        drop_written(done)
    return (
        sketches.select("doc_id", "n", "sig")
        .join(class_of, "sig", "left")
        .select(F.col("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates: the smallest id's, a null id
    last, and of rows that repeat it the least by a digest of all columns.

    Rows are linked by numbers of their own, so ids may be null or repeated with
    any texts. A row without words is linked with nothing and stays; of such
    rows that are equal in every column one does.
    """
    ready(docs.sparkSession)
    # Written once, so that the numbers are the same wherever they are read.
    rows = written(docs.withColumn("_sl_row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, "_sl_row", text_col, width, percent).select(F.col("doc_id").alias("_sl_row"), "n_shingles", "component_id")
    digest = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), {"ignoreNullFields": "false"}))
    keys = rows.select("_sl_row", F.col(id_col).alias("_sl_id"), digest.alias("_sl_digest"))
    group = F.when(F.col("n_shingles") > 0, F.col("component_id").cast("string")).otherwise(F.concat(F.lit("="), "_sl_digest"))
    first = F.min(F.struct(F.col("_sl_id").isNull().alias("none"), F.col("_sl_id").alias("id"), F.col("_sl_digest").alias("digest"), F.col("_sl_row").alias("row")))
    chosen = keys.join(found, "_sl_row").groupBy(group.alias("_sl_group")).agg(first.alias("first")).select(F.col("first.row").alias("_sl_row"))
    return rows.join(chosen, "_sl_row", "left_semi").drop("_sl_row")
