"""Mixture-controlled packing by deficit round-robin over source queues.

1. Each task tokenises its documents and appends them to its queue per source;
   a table keeps ids and the place in the queue.
2. Prefix sums over (task, source) totals make one queue per source out of the
   tasks' queues: every document knows how many of its source's tokens come
   before it. Only totals are shuffled.
3. The mixing schedule gives every window (``WINDOW`` sequences) its tokens per
   source: the target of the window and the deficit carried into it, in whole
   tokens; what is then too much or too little is the deficit that the next
   window starts from. Windows span partitions, and so do the deficits, which
   follow from cumulative targets without reading the windows before. A source
   that ends hands its share to the others.
4. A document's place in its queue says which windows take its tokens; pieces
   are shuffled to their windows once.
5. In a window, sources are served in rounds, from the deficits carried in: a
   source's deficit grows by its quantum, its target share of a sequence, and it
   sends pieces while the deficit is positive; what the last one takes too much
   stays owed. The stream is cut into sequences without gaps.

The tokens of a window are exactly its sequences' room, so only the last window
has padding; its last sequence is cut at powers of two, which need none.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import ready, written
from sievelake.llm.tokens import WordTokenizer, default_tokenizer

#: Sequences of a window.
WINDOW = 64
#: Sources that a mixture may have: a schedule of all of them is in every task.
MAX_SOURCES = 10_000


class Schedule:
    """How many tokens of each source the windows have taken before window w.

    Sources are consumed at fixed shares until one ends; then the shares are
    those of the rest. ``marks`` are the total positions where one ends. A
    cumulative sum over sources is rounded, so windows are filled exactly.
    """

    def __init__(self, supply: list[int], weights: list[float], room: int):
        self.supply, self.room = supply, room
        self.marks: list[tuple[float, list[float], list[float]]] = []
        taken, at = [0.0] * len(supply), 0.0
        left = {i for i, n in enumerate(supply) if n > 0}
        while left:
            total = sum(weights[i] for i in left)
            share = [weights[i] / total if i in left else 0.0 for i in range(len(supply))] if total > 0 else [1 / len(left) if i in left else 0.0 for i in range(len(supply))]
            length = min((supply[i] - taken[i]) / share[i] for i in left if share[i] > 0)
            self.marks.append((at, taken[:], share))
            at += length
            taken = [min(float(n), t + s * length) for n, t, s in zip(supply, taken, share)]
            left = {i for i in left if supply[i] - taken[i] > 0.5}
        self.total = sum(supply)
        self.windows = -(-self.total // room)

    def target(self, window: int) -> list[float]:
        """Tokens that each source is due in the windows before this one."""
        position = min(window * self.room, self.total)
        if not self.marks:
            return [0.0] * len(self.supply)
        at, taken, share = self.marks[max(0, bisect_right([m[0] for m in self.marks], position) - 1)]
        return [min(float(n), t + s * (position - at)) for n, t, s in zip(self.supply, taken, share)]

    def deficits(self, window: int) -> list[float]:
        """What each source is owed, or has had too much, when a window starts."""
        return [due - had for due, had in zip(self.target(window), self.before(window))]

    def before(self, window: int) -> list[int]:
        """Tokens of each source in the windows before this one."""
        position = window * self.room
        if position >= self.total:
            return list(self.supply)
        exact = self.target(window)
        out, cumulative, done = [], 0.0, 0
        for i, x in enumerate(exact):
            cumulative += x
            edge = position if i == len(exact) - 1 else int(cumulative + 0.5)
            out.append(edge - done)
            done = edge
        return self._within(out, position)

    def _within(self, out: list[int], position: int) -> list[int]:
        """Rounding may ask a source for a token more than it has or for less
        than none; others give or take those."""
        out = [min(max(0, x), n) for x, n in zip(out, self.supply)]
        missing = position - sum(out)
        for i, n in enumerate(self.supply):
            step = min(missing, n - out[i]) if missing > 0 else max(missing, -out[i])
            out[i] += step
            missing -= step
        return out

    def window_of(self, source: int, place: int) -> int:
        """The window that takes the token at this place of the queue."""
        lo, hi = 0, max(0, self.windows - 1)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.before(mid)[source] <= place:
                lo = mid
            else:
                hi = mid - 1
        return lo


def tokenised(docs: DataFrame, id_col: str, text_col: str, source_col: str, path: str) -> DataFrame:
    """(block, source, off, doc_id, n, ids): ``off`` is the number of the
    source's tokens before this document in the block, a task's documents."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer.of(path)
        block, used = TaskContext.get().partitionId(), {}
        for batch in batches:
            ids = words.encode(batch.column(2).to_pylist())
            n = [len(x) // words.dtype.itemsize for x in ids]
            off = []
            for source, k in zip(batch.column(1).to_pylist(), n):
                off.append(used.get(source, 0))
                used[source] = off[-1] + k
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(n), pa.int64()), batch.column(1), pa.array(off, pa.int64()), batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["block", "source", "off", "doc_id", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).cast("binary").alias("raw"))
    return rows.mapInArrow(encode, "block bigint, source string, off bigint, doc_id bigint, n bigint, ids binary")


def _deal(schedule: Schedule, numbers: dict[str, int], itemsize: int):
    """Cut each document at the borders of windows."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, list[int]] = {}

        def before(w: int) -> list[int]:
            if w not in cache:
                cache[w] = schedule.before(w)
            return cache[w]

        hint = [0] * len(numbers)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, source, place, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                s, start = numbers[source], 0
                w = hint[s]  # the next document of a source mostly meets the same window
                if not (before(w)[s] <= place < before(w + 1)[s]):
                    w = schedule.window_of(s, place)
                while start < n:
                    while before(w + 1)[s] <= place + start:
                        w += 1
                    stop = min(n, before(w + 1)[s] - place)
                    for col, value in zip(out, (w, s, place + start, doc, start, n, ids[start * itemsize : stop * itemsize])):
                        col.append(value)
                    start = stop
                hint[s] = w
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["window", "source_no", "place", "doc_id", "start", "doc_tokens", "ids"])

    return deal


SCHEMA = "sequence_id bigint, window bigint, n_tokens bigint, ids binary, segments array<struct<doc_id:bigint,start:bigint,length:bigint,doc_tokens:bigint,source_no:int,offset:bigint>>"
_SEGMENT = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("source_no", pa.int32()), ("offset", pa.int64())])


def serve(queues: dict[int, list[tuple]], due: dict[int, float], carried: dict[int, float], length: int) -> list[tuple]:
    """Deficit round-robin over one window's queues of (doc_id, start, doc_tokens,
    ids): the pieces in the order of service as (source, doc_id, start,
    doc_tokens, ids). ``due`` are the tokens of the window's target and
    ``carried`` the deficits that it starts from. Quanta are the targets' shares
    of a sequence, so a round is about one sequence; whole pieces go while the
    deficit is positive, and what they take too much stays owed."""
    total = max(1.0, sum(due.values()))
    quantum = {s: max(1.0, length * due.get(s, 0.0) / total) for s in queues}
    deficit = {s: carried.get(s, 0.0) for s in queues}
    heads, out = dict.fromkeys(queues, 0), []
    left = sorted(queues)
    while left:
        for s in list(left):
            deficit[s] += quantum[s]
            q = queues[s]
            while deficit[s] > 0 and heads[s] < len(q):
                doc, start, tokens, ids = q[heads[s]]
                out.append((s, doc, start, tokens, ids))
                heads[s] += 1
                deficit[s] -= len(ids)
            if heads[s] == len(q):
                left.remove(s)
    return out


def _fill(schedule: Schedule, length: int, dtype: np.dtype):
    def fill(table: pa.Table) -> pa.Table:
        window = table["window"][0].as_py()
        due = dict(enumerate(b - a for a, b in zip(schedule.target(window), schedule.target(window + 1))))
        carried = dict(enumerate(schedule.deficits(window)))
        rows = sorted(zip(*(table[c].to_pylist() for c in ("source_no", "place", "doc_id", "start", "doc_tokens", "ids"))), key=lambda r: (r[0], r[1]))
        queues: dict[int, list[tuple]] = {}
        for s, _, doc, start, tokens, ids in rows:
            queues.setdefault(s, []).append((doc, start, tokens, np.frombuffer(ids, dtype)))
        total = sum(len(p[3]) for q in queues.values() for p in q)
        sizes = [length] * (total // length)
        rest = total - length * len(sizes)
        while rest:  # powers of two need no padding
            sizes.append(1 << (rest.bit_length() - 1))
            rest -= sizes[-1]
        cols: list[list] = [[] for _ in range(5)]
        stream, at = iter(serve(queues, due, carried, length)), 0
        piece = next(stream, None)
        for k, size in enumerate(sizes):
            row, segments, used = np.zeros(size, "<u4"), [], 0
            while used < size:
                s, doc, start, tokens, ids = piece
                n = min(size - used, len(ids) - at)
                row[used : used + n] = ids[at : at + n]
                segments.append({"doc_id": doc, "start": start + at, "length": n, "doc_tokens": tokens, "source_no": s, "offset": used})
                used, at = used + n, at + n
                if at == len(ids):
                    piece, at = next(stream, None), 0
            for col, value in zip(cols, (window * (WINDOW + 64) + k, window, size, row.tobytes(), segments)):
                col.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(_SEGMENT)))], ["sequence_id", "window", "n_tokens", "ids", "segments"])

    return fill


def pack_mixture(docs: DataFrame, weights: dict[str, float] | None = None, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str | None = None, temperature: float = 0.5) -> DataFrame:
    """Sequences of ``length`` tokens: sequence_id, window, n_tokens, ids
    (little-endian unsigned 32 bits) and segments (doc_id, start, length,
    doc_tokens, source_no, offset), every token of every row in exactly one.

    ``weights`` are target token proportions per source (a source it lacks has
    weight 0 and comes last); without it, a source's tokens to the power
    ``temperature``: small sources get more than their share of a window until
    they end, and 1 makes every window look like the whole. A null source is the source of empty name; null and
    empty texts are the end id alone; repeated rows are packed again; other
    columns are ignored; an empty table gives no sequences. The tail of the
    last window is cut at powers of two. Ids are integers (others are cast). The
    sources are a list of at most MAX_SOURCES, as their totals go to the driver.
    """
    ready(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    dtype = WordTokenizer.of(path).dtype
    rows = written(tokenised(docs, id_col, text_col, source_col, path), "tokens")
    totals = rows.groupBy("block", "source").agg(F.sum("n").alias("tokens"))
    queue = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = written(totals.withColumn("ahead", F.coalesce(F.sum("tokens").over(queue), F.lit(0))), "ahead")
    by_source = ahead.groupBy("source").agg(F.sum("tokens")).limit(MAX_SOURCES + 1).collect()
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them before packing")
    supply = {r[0]: r[1] for r in by_source}
    names = sorted(supply)
    wanted = [float(supply[s]) ** temperature if weights is None else float(weights.get(s, 0.0)) for s in names]
    schedule = Schedule([supply[s] for s in names], wanted, WINDOW * length)
    pieces = (
        rows.join(ahead.select("block", "source", "ahead"), ["block", "source"])
        .select("doc_id", "source", (F.col("ahead") + F.col("off")).alias("place"), "n", "ids")
        .mapInArrow(_deal(schedule, {s: i for i, s in enumerate(names)}, dtype.itemsize), "window bigint, source_no int, place bigint, doc_id bigint, start bigint, doc_tokens bigint, ids binary")
    )
    return pieces.groupBy("window").applyInArrow(_fill(schedule, length, dtype), SCHEMA)


def pieces_of(packed: DataFrame) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, the checksum taken from the packed ids."""
    return packed.select("sequence_id", "ids", F.explode("segments").alias("s")).select(
        "s.doc_id", "s.start", "s.length",
        F.crc32(F.expr("substring(ids, cast(4 * s.offset + 1 as int), cast(4 * s.length as int))")).alias("ids_crc32"),
        "s.doc_tokens", "sequence_id", "s.offset",
    )
