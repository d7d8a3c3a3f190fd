"""Best-fit-decreasing packing of token ids into fixed-length sequences.

Documents longer than a sequence are cut into full pieces and a rest, without
loss. Pieces go, longest first, into the open sequence with the least room that
still holds them; a segment tree over capacities finds that room in logarithmic
time. Each task packs its own documents in blocks of bounded size, so ids are
never shuffled, and a lost executor costs its tasks only. Padding per block is
what its last few sequences leave. Sequences are written as binary matrices of
ids; a manifest has their segment lengths and position resets.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import ready, shared_folder, written
from sievelake.llm.tokens import WordTokenizer, default_tokenizer

#: Tokens that a task packs together; bounds its memory (2 bytes a token).
BLOCK_TOKENS = 8_000_000


class RoomTree:
    """Segment tree over rooms 0..capacity: per room the sequences that have it,
    per node whether any lies below."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.at[room].append(sequence)
        i = room + self.size
        while i and not self.some[i]:
            self.some[i] = 1
            i >>= 1

    def take(self, room: int) -> tuple[int, int] | None:
        """(room, sequence) of the least room of at least this, removed."""
        i = room + self.size
        if not self.some[i]:
            while i > 1 and (i & 1 or not self.some[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        room = i - self.size
        sequence = self.at[room].pop()
        if not self.at[room]:
            self.some[i] = 0
            i >>= 1
            while i and not (self.some[2 * i] or self.some[2 * i + 1]):
                self.some[i] = 0
                i >>= 1
        return room, sequence


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Numbers of the pieces in each sequence; every size is 1 to capacity."""
    tree, out = RoomTree(capacity), []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = tree.take(sizes[k])
        if found is None:
            found = (capacity, len(out))
            out.append([])
        room, sequence = found
        out[sequence].append(k)
        if room > sizes[k]:
            tree.put(room - sizes[k], sequence)
    return out


SCHEMA = "sequence_id bigint, n_tokens int, ids binary, cu_seqlens array<int>, doc_ids array<bigint>, starts array<bigint>, position_resets array<int>"


def pack_best_fit(docs: DataFrame, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Packed sequences: sequence_id, n_tokens, ids (little-endian unsigned, of
    16 bits while the vocabulary allows, else 32; padded with 0 to ``length``),
    cu_seqlens (segment borders, from 0 to n_tokens), doc_ids and starts (per
    segment: its document and how many of that document's ids come before) and
    position_resets (the borders where position ids start again from 0, a
    document's first id; a segment that continues one goes on from its start).

    Null and empty texts are the end id alone. Every id of every row lies in
    exactly one segment; repeated rows are packed again. A null id stays null;
    ids are integers (others are cast). An empty table gives no sequences. sequence_id is unique, not gapless.
    """
    ready(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    dtype = WordTokenizer.of(path).dtype

    def sequences(owners: list, ids: list[np.ndarray], first: int) -> pa.RecordBatch:
        pieces = [(d, s, min(length, len(x) - s)) for d, x in enumerate(ids) for s in range(0, len(x), length)]
        packed = best_fit([n for _, _, n in pieces], length)
        cols: list[list] = [[] for _ in range(7)]
        for k, members in enumerate(packed):
            row = np.zeros(length, dtype)
            borders = [0]
            for m in members:
                d, s, n = pieces[m]
                row[borders[-1] : borders[-1] + n] = ids[d][s : s + n]
                borders.append(borders[-1] + n)
            starts = [pieces[m][1] for m in members]
            for col, value in zip(cols, (first + k, borders[-1], row.tobytes(), borders, [owners[pieces[m][0]] for m in members], starts, [b for b, s in zip(borders, starts) if not s])):
                col.append(value)
        types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["sequence_id", "n_tokens", "ids", "cu_seqlens", "doc_ids", "starts", "position_resets"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer.of(path)
        number = TaskContext.get().partitionId() << 32
        owners, ids, tokens = [], [], 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, data in zip(names, words.encode(batch.column(1).to_pylist())):
                owners.append(name)
                ids.append(np.frombuffer(data, words.dtype))
                tokens += len(ids[-1])
                if tokens >= BLOCK_TOKENS:
                    out = sequences(owners, ids, number)
                    number += len(out)
                    for i in range(0, len(out), 500):
                        yield out.slice(i, 500)
                    owners, ids, tokens = [], [], 0
        if ids:
            out = sequences(owners, ids, number)
            for i in range(0, len(out), 500):
                yield out.slice(i, 500)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(pack, SCHEMA)


PLACE = "sequence_id bigint, n_tokens int, cu_seqlens array<int>, doc_ids array<bigint>, starts array<bigint>, position_resets array<int>, file string, row bigint, id_bytes int, ids_crc32 bigint"


def write_matrices(packed: DataFrame, folder: str | None = None, length: int = 2048) -> DataFrame:
    """Write each partition's sequences as one raw matrix of little-endian
    unsigned ids (rows of ``length``, ``id_bytes`` bytes an id) into a shared
    folder. The manifest has a row per sequence: all columns but ids, then file,
    row, id_bytes and ids_crc32 (of the padded row).

    Files are named by attempt, and the manifest is a table committed by Spark:
    only files that it names count. An empty table writes no file."""
    folder = folder or shared_folder(packed.sparkSession) + "/matrices"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        name, out, at = f"{uuid.uuid4().hex}.ids", None, 0
        for batch in batches:
            rows = batch.column("ids").to_pylist()
            if rows and out is None:
                files.create_dir(path, recursive=True)
                out = files.open_output_stream(f"{path}/{name}")
            for row in rows:
                out.write(row)
            n = len(rows)
            more = ([f"{folder}/{name}"] * n, range(at, at + n), [len(r) // length for r in rows], map(zlib.crc32, rows))
            columns = [pa.array(list(c), t) for c, t in zip(more, (pa.string(), pa.int64(), pa.int32(), pa.int64()))]
            kept = batch.drop_columns(["ids"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, "file", "row", "id_bytes", "ids_crc32"])
            at += n
        if out is not None:
            out.close()

    return written(packed.mapInArrow(write, PLACE), "manifest")
