"""Language-model scores by a weighted backoff automaton over word n-grams.

The model interpolates orders by Dirichlet smoothing: with c the count of an
n-gram in the training documents and h its context,

    P_n(w | h) = (c(hw) + K_n * P_{n-1}(w | h')) / (c(h) + K_n),  K_n = a_n + b_n * c(h)

down to the add-half unigrams. As an automaton: a state is a context seen in
training, the root the empty one. An arc of a state is a seen n-gram; it weighs
its log-probability and leads to the longest seen context that ends with its
word. A state's failure arc weighs K_n / (c(h) + K_n) and leads to the state of
the shorter context. A text is read once from left to right: its state is
carried from word to word, failure arcs are followed until a state has an arc
for the word, and weights add up.

The model is never gathered in one place. Documents are encoded in blocks of
bounded size, which are written once. A block sends, for each of its distinct
n-grams, the hash and its training count to the n-gram's bucket, packed as one
array per block and bucket; buckets grow in number with the input. A bucket sums
the counts over all blocks and answers every block with the totals of its
n-grams in the order asked. With the answers, each block has the part of the
automaton that its texts can reach, and runs it over its texts side by side.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import claim_cache, keeps_cache, ready, written

ORDER = 3
#: (a_n, b_n) for n = 2, 3, ...: how much evidence the shorter context is worth.
STRENGTH = ((4.0, 2.0), (1.0, 1.0))
#: Bytes of text in a block; bounds the memory of every Python step.
BLOCK_BYTES = 8_000_000
#: Words that the automaton reads in one go; a longer text goes on in the state
#: that its words before leave.
RUN = 512
END = b"\n"  # no word holds a line break

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Hashes have 56 bits, the lowest three of which are the n-gram's order.
HASH_BYTES, ORDER_BITS = 7, np.uint64(7)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word) >> 8
        if len(self) < 400_000:
            self[word] = h
        return h


_WORDS = _WordHash()
keeps_cache("lm", _WORDS.clear)


def held_out(doc_id: object) -> bool:
    """Training leaves out a fifth of the documents by their id's checksum."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def words_of(raw: bytes | None) -> np.ndarray:
    """Hashes of the words, A-Z in lower case, then one end."""
    ws = (raw or b"").lower().split()
    ws.append(END)
    return np.fromiter(map(_WORDS.__getitem__, ws), np.uint64, len(ws))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _K2
    return h ^ (h >> np.uint64(29))


@dataclass
class Grams:
    """The distinct n-grams of one order in a block: a number of the context
    (of order n - 1, or one past the last for the start of a text) times the
    number of types plus the word's, in order; which of them ends at each
    token; each one's suffix of order n - 1; and its hash."""

    keys: np.ndarray
    ends: np.ndarray
    suffix: np.ndarray
    hashes: np.ndarray


def grams(words: np.ndarray, types: np.ndarray, sizes: np.ndarray, order: int) -> list[Grams]:
    """Those of orders 1 to ``order`` of texts given as numbers of types."""
    starts = np.cumsum(sizes) - sizes
    tagged = lambda h, n: _mix(h * _K1) >> np.uint64(8) & ~ORDER_BITS | np.uint64(n)
    every = np.arange(len(types))
    out = [Grams(every, words, np.zeros(len(types), np.int64), tagged(types, 1))]
    for n in range(2, order + 1):
        low = out[-1]
        context = np.empty(len(words), np.int64)
        context[1:] = low.ends[:-1]
        context[starts] = len(low.keys)
        keys, ends = np.unique(context * len(types) + words, return_inverse=True)
        suffix = np.empty(len(keys), np.int64)
        suffix[ends] = low.ends
        before = np.append(low.hashes, np.uint64(0))[keys // len(types)]
        out.append(Grams(keys, ends, suffix, tagged(before * _K2 + types[keys % len(types)], n)))
    return out


def sorted_counts(every: list[Grams], train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all orders in order, their training counts, and
    the order itself."""
    hashes = np.concatenate([g.hashes for g in every])
    counts = np.concatenate([np.bincount(g.ends, train, len(g.keys)).astype(np.int64) for g in every])
    order = np.argsort(hashes, kind="stable")
    return hashes[order], counts[order], order


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents into blocks: ids, and the lengths and words of texts."""

    def block(number: int, ids: list, texts: list[np.ndarray]) -> pa.RecordBatch:
        types, words, times = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
        often = np.argsort(-times, kind="stable")  # small numbers for frequent words
        number_of = np.empty(len(types), "<u4")
        number_of[often] = np.arange(len(types))
        sizes = np.array([len(t) for t in texts], "<i4")
        cols = ([number], [ids_array(ids).tobytes()], [packed(sizes, 4)], [packed(number_of[words], 4)], [packed(types[often], HASH_BYTES)], [sum(not held_out(i) for i in ids)])
        types_of = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types_of)], ["block", "ids", "sizes", "words", "types", "n_train"])

    claim_cache("lm")
    number, ids, texts, size = TaskContext.get().partitionId() << 24, [], [], 0
    for batch in batches:
        for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(name)
            texts.append(words_of(raw))
            size += len(raw or b"")
            if size >= BLOCK_BYTES:
                yield block(number, ids, texts)
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield block(number, ids, texts)


BLOCKS = "block bigint, ids binary, sizes binary, words binary, types binary, n_train bigint"
BODY = ["ids", "sizes", "words", "types"]


def decoded(ids: bytes, sizes: bytes, words: bytes, types: bytes) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sizes, words, types, train) of a block."""
    names = [v if known else None for known, v in np.frombuffer(ids, "<i8").reshape(-1, 2).tolist()]
    n = unpacked(sizes, 4).astype(np.int64)
    train = np.repeat(np.array([not held_out(i) for i in names]), n)
    return names, n, unpacked(words, 4).astype(np.int64), unpacked(types, HASH_BYTES), train


def packed(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of numbers, plane by plane, compressed: high
    bytes are mostly zero."""
    planes = np.ascontiguousarray(values.astype("<u8").view("u1").reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1").reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), "u1")
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as their steps."""
    return packed(np.diff(keys, prepend=np.uint64(0)), HASH_BYTES)


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, HASH_BYTES), dtype=np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so sorted keys are in their order."""
    return ((keys >> np.uint64(24)) * np.uint64(buckets)) >> np.uint64(32)


def _ask(order: int, buckets: int):
    """A row per block and bucket with the block's distinct n-grams and counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache("lm")
        _WORDS.clear()  # words are hashed
        for batch in batches:
            for number, *body in zip(*(c.to_pylist() for c in batch.columns)):
                _, sizes, words, types, train = decoded(*body)
                keys, counts, _ = sorted_counts(grams(words, types, sizes, order), train)
                edges = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
                rows = [(number, int(b), packed_keys(keys[edges[b] : edges[b + 1]]), packed(counts[edges[b] : edges[b + 1]], 8)) for b in np.flatnonzero(np.diff(edges))]
                out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["block", "bucket", "keys", "counts"])
                for i in range(0, len(out), 64):
                    yield out.slice(i, 64)

    return ask


def ids_array(ids: list) -> np.ndarray:
    """Ids as pairs (known, value), so that null ids come back."""
    return np.array([(i is not None, 0 if i is None else i) for i in ids], "<i8").reshape(-1, 2)


def _answers(table: pa.Table) -> pa.Table:
    """One bucket: total counts of its n-grams, sent back to each block in the
    order of its keys; and, as block -1, the words' tokens and types."""
    keys = [unpacked_keys(k) for k in table["keys"].to_pylist()]
    counts = [unpacked(c, 8) for c in table["counts"].to_pylist()]
    u, inv = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(inv, np.concatenate(counts), len(u)).astype("<u8")
    words = sums[(u & ORDER_BITS) == 1]
    edges = np.cumsum([0] + [len(k) for k in keys])
    total = sums[inv]
    totals = [packed(total[edges[i] : edges[i + 1]], 8) for i in range(len(keys))]
    totals.append(packed(np.array([words.sum(), (words > 0).sum()], "<u8"), 8))
    bucket = table["bucket"].to_pylist()
    return pa.table({"block": pa.array([*table["block"].to_pylist(), -1], pa.int64()), "bucket": pa.array([*bucket, bucket[0]], pa.int64()), "totals": pa.array(totals, pa.binary())})


class Automaton:
    """The part of the model that a block's texts can reach.

    States are numbered level by level, the root being 0: of a level, a state
    per distinct n-gram of the block and one for the start of a text. ``arcs``
    has, per order, the seen n-grams' keys, weights and destinations.
    """

    def __init__(self, every: list[Grams], counts: list[np.ndarray], n_train: int, n_tokens: int, n_types: int, strength: tuple):
        self.every, self.kinds, order = every, len(every[0].keys), len(every)
        sizes = [len(g.keys) for g in every]
        self.base = np.cumsum([0, 1] + [s + 1 for s in sizes[: order - 1]])  # first state of each level
        states = int(self.base[-1])
        self.fail, self.fail_weight, self.seen = np.zeros(states, np.int64), np.zeros(states), np.zeros(states, bool)
        self.seen[0] = True
        for k in range(1, order):  # contexts of k words
            at, end = int(self.base[k]), int(self.base[k + 1])
            c = np.append(counts[k - 1], n_train).astype(np.float64)
            a, b = strength[k - 1]
            strong = a + b * c
            self.seen[at:end] = c > 0
            self.fail_weight[at:end] = np.log10(strong / (c + strong))
            if k > 1:  # one word's context fails to the root
                self.fail[at:end] = self.base[k - 1] + np.append(every[k - 1].suffix, sizes[k - 2])
        c = counts[0].astype(np.float64)
        p = (c + 0.5) / (n_tokens + 0.5 * (n_types + 1))
        self.known, self.base_weight = c > 0, np.log10(p)
        self.arcs = [(every[0].keys, self.base_weight, np.where(self.known, self.base[1] + every[0].keys, 0) if order > 1 else np.zeros(self.kinds, np.int64))]
        for n in range(2, order + 1):
            g, c = every[n - 1], counts[n - 1].astype(np.float64)
            context = np.append(counts[n - 2], n_train).astype(np.float64)[g.keys // self.kinds]
            a, b = strength[n - 2]
            strong = a + b * context
            p = np.where(context > 0, (c + strong * p[g.suffix]) / np.maximum(context + strong, 1e-300), p[g.suffix])
            has = c > 0
            to = self.base[n] + np.flatnonzero(has) if n < order else self.base[n - 1] + g.suffix[has]
            self.arcs.append((g.keys[has], np.log10(p[has]), to))

    def start(self) -> int:
        """The state before a text's first word: the longest start context."""
        state = int(self.base[-1]) - 1
        return state if self.seen[state] else 0

    def after(self, token: np.ndarray) -> np.ndarray:
        """The state that the words up to each of these tokens leave."""
        out = np.zeros(len(token), np.int64)
        for k in range(1, len(self.every)):
            state = self.base[k] + self.every[k - 1].ends[token]
            out = np.where(self.seen[state], state, out)
        return out

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read one word in each of these states: weights and next states."""
        weight, to = np.zeros(len(state)), np.zeros(len(state), np.int64)
        state, left = state.copy(), np.arange(len(state))
        for n in range(len(self.arcs), 0, -1):
            keys, weights, dest = self.arcs[n - 1]
            here = state[left] >= self.base[n - 1]  # states of n - 1 words; shorter ones wait
            at = left[here]
            if not len(at):
                continue
            asked = (state[at] - self.base[n - 1]) * self.kinds + word[at]
            i = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
            hit = keys[i] == asked if len(keys) else np.zeros(len(at), bool)
            weight[at[hit]] += weights[i[hit]]
            to[at[hit]] = dest[i[hit]]
            fails = at[~hit]
            weight[fails] += self.fail_weight[state[fails]]
            state[fails] = self.fail[state[fails]]
            left = np.concatenate([left[~here], fails])
        return weight, to

    def read(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The log10 probability of every token, all texts side by side."""
        first = np.cumsum(sizes) - sizes
        runs = -(-sizes // RUN)
        number = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        begin = np.repeat(first, runs) + number * RUN
        length = np.minimum(RUN, np.repeat(first + sizes, runs) - begin)
        longest = np.argsort(-length, kind="stable")
        begin, length, number = begin[longest], length[longest], number[longest]
        state = np.where(number > 0, self.after(np.maximum(begin - 1, 0)), self.start())
        out = np.zeros(len(words))
        active = np.searchsorted(-length, -np.arange(RUN))  # runs longer than this
        for j in range(int(length.max(initial=0))):
            at = begin[: active[j]] + j
            out[at], state[: active[j]] = self.step(state[: active[j]], words[at])
        return out


SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(order: int, n_train: int, n_tokens: int, n_types: int, strength: tuple):
    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names, sizes, words, types, train = decoded(*(left[c][0].as_py() for c in BODY))
        every = grams(words, types, sizes, order)
        *_, sent = sorted_counts(every, train)
        answers = sorted(zip(right["bucket"].to_pylist(), right["totals"].to_pylist()))
        counts = np.empty(len(sent), np.int64)
        counts[sent] = np.concatenate([unpacked(a, 8) for _, a in answers]).astype(np.int64)
        counts = np.split(counts, np.cumsum([len(g.keys) for g in every])[:-1])
        model = Automaton(every, counts, n_train, n_tokens, n_types, strength)
        full = model.read(words, sizes)
        at = np.cumsum(sizes) - sizes
        out = {
            "doc_id": pa.array(names, pa.int64()),
            "held_out": pa.array([held_out(i) for i in names]),
            "n_tokens": pa.array(sizes),
            "n_known": pa.array(np.add.reduceat(model.known[words].astype(np.int64), at)),
            "train_tokens": pa.array([n_tokens] * len(names), pa.int64()),
            "base_score": pa.array(np.add.reduceat(model.base_weight[words], at)),
            "score": pa.array(np.add.reduceat(full, at)),
        }
        return pa.table(out)

    return score


def _unigram_totals(answers: DataFrame) -> tuple[int, int]:
    """Training tokens and distinct ones: two numbers per bucket, summed here."""
    n = v = 0
    for r in answers.where("block < 0").select("totals").toLocalIterator():
        x = unpacked(bytes(r[0]), 8)
        n, v = n + int(x[0]), v + int(x[1])
    return n, v


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, strength: tuple = STRENGTH, buckets: int | None = None) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score, both log10 probabilities of the whole text and its end.

    Null and empty texts are the end alone. Repeated rows train and are scored
    again. A null id counts as the empty text in the split; ids are integers
    (others are cast). Other columns are ignored; an empty table gives no rows.
    Counts cover all training documents, up to collisions of 53-bit hashes.
    ``order`` is 2 to 7. ``buckets`` defaults to four per input partition.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    buckets = buckets or 4 * max(2, rows.rdd.getNumPartitions())
    blocks = written(rows.mapInArrow(_encode, BLOCKS), "blocks")
    asked = blocks.select("block", *BODY).mapInArrow(_ask(order, buckets), "block bigint, bucket bigint, keys binary, counts binary")
    answers = written(asked.groupBy("bucket").applyInArrow(_answers, "block bigint, bucket bigint, totals binary"), "answers")
    n_tokens, n_types = _unigram_totals(answers)
    n_train = blocks.agg(F.coalesce(F.sum("n_train"), F.lit(0))).first()[0]
    scored = blocks.select("block", *BODY).groupBy("block").cogroup(answers.where("block >= 0").groupBy("block"))
    return scored.applyInArrow(_score(order, n_train, n_tokens, n_types, strength), SCHEMA)
