"""Media columns: content-addressed payloads in tar shards.

Each task packs its payloads into one tar shard in the shared folder, as 8-bit
grey PNG pictures 64 samples wide; a payload that the task has seen before is
not stored again. The manifest has digest, shard, offset and length. A digest's
address is the first of its places (shard, then offset), so all equal payloads
resolve to one stored form although texts are never shuffled: only digests are.

Shards have names of their own attempt, and the manifest is a table committed
by Spark: rows point only to shards of attempts that ended, so a lost executor
leaves at most an unreferenced file behind.

Rows carry digest, shard, offset and length. ``read_headers`` fills metadata
columns (width, height, depth) by range reads of the header bytes alone;
``read_features`` reads whole payloads by their ranges, for what needs them.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import ready, shared_folder, written

WIDTH = 64
#: PNG signature, and the bytes from its start through the header chunk.
SIGNATURE, HEADER_BYTES = b"\x89PNG\r\n\x1a\n", 33
PLACE = "digest string, shard string, offset bigint, length bigint, n_bytes bigint"


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 4) -> bytes:
    """8-bit grey picture, 64 samples a line, filter 0: the samples are the
    payload's bytes in order."""
    lines = len(payload) // WIDTH
    head = struct.pack(">IIBBBBB", WIDTH, lines, 8, 0, 0, 0, 0)
    rows = b"\0" + b"\0".join(payload[i : i + WIDTH] for i in range(0, len(payload), WIDTH))
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows, level)) + _chunk(b"IEND", b"")


def png_size(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER_BYTES."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of a picture that :func:`to_png` made; a chunk whose checksum
    is wrong is an error."""
    at, idat = 8, b""
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        (crc,) = struct.unpack(">I", data[at + 8 + n : at + 12 + n])
        if zlib.crc32(data[at + 4 : at + 8 + n]) != crc:
            raise ValueError("a PNG chunk is damaged")
        if data[at + 4 : at + 8] == b"IDAT":
            idat += data[at + 8 : at + 8 + n]
        at += 12 + n
    rows = zlib.decompress(idat)
    return b"".join(rows[i + 1 : i + 1 + WIDTH] for i in range(0, len(rows), WIDTH + 1))


def tar_header(name: str, size: int) -> bytes:
    """A ustar header; sizes over the octal field are written in base 256."""
    sized = f"{size:011o}\0".encode() if size < 8**11 else b"\x80" + size.to_bytes(11, "big")
    head = bytearray(struct.pack("100s8s8s8s12s12s8s1s100s6s2s32s32s8s8s155s12s", name.encode(), b"0000644\0", b"0000000\0", b"0000000\0", sized, b"00000000000\0", b" " * 8, b"0", b"", b"ustar\0", b"00", b"", b"", b"", b"", b"", b""))
    head[148:156] = f"{sum(head):06o}\0 ".encode()
    return bytes(head)


def feature_of(payload: bytes) -> str:
    """Mean and spread of the samples, and an 8-bin histogram in thousandths."""
    n = len(payload)
    counts = Counter(payload)
    total = sum(k * v for k, v in counts.items())
    square = sum(k * k * v for k, v in counts.items())
    bins = [0] * 8
    for k, v in counts.items():
        bins[k >> 5] += v
    mean = total / n
    return f"{mean:.4f}|{max(0.0, square / n - mean * mean) ** 0.5:.4f}|" + ",".join(str(1000 * b // n) for b in bins)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write shards; the manifest (id, digest, shard, offset, length, n_bytes),
    one row per row of ``docs``. digest is the SHA-256 of the padded payload.

    Null and empty texts share one payload of 64 zero bytes. Texts of any
    length are stored whole. Repeated rows share a payload. Other columns are
    ignored; an empty table writes no shard.
    """
    spark = ready(docs.sparkSession)
    folder = folder or shared_folder(spark) + "/shards"

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shard, at, seen = None, None, 0, {}
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                payload = pad(raw or b"")
                key = hashlib.sha256(payload).digest()
                if key not in seen:
                    if out is None:
                        fs, path = _filesystem(folder)
                        fs.create_dir(path, recursive=True)
                        shard = f"{uuid.uuid4().hex}.tar"
                        out = fs.open_output_stream(f"{path}/{shard}")
                    media = to_png(payload)
                    out.write(tar_header(key.hex() + ".png", len(media)))
                    out.write(media)
                    out.write(b"\0" * (-len(media) % 512))
                    seen[key] = (at + 512, len(media))
                    at += 512 + len(media) + -len(media) % 512
                rows.append((key.hex(), f"{folder}/{shard}", *seen[key], len(raw or b"")))
            cols = list(zip(*rows)) or [()] * 5
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], [id_col, "digest", "shard", "offset", "length", "n_bytes"])
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()

    kind = docs.schema[id_col].dataType.simpleString()
    return written(docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_sl_text")).mapInArrow(store, f"{id_col} {kind}, {PLACE}"), "manifest")


def addresses(manifest: DataFrame) -> DataFrame:
    """One place per digest: (digest, shard, offset, length)."""
    return manifest.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.shard", "p.offset", "p.length")


def _ranged(places: DataFrame, read, schema: str) -> DataFrame:
    """Run ``read(file, digest, offset, length)`` for each place, shard by shard and in
    the order of offsets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = []
            for digest, shard, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != name:
                    if file is not None:
                        file.close()
                    fs, path = _filesystem(shard)
                    name, file = shard, fs.open_input_file(path)
                rows.append((digest, *read(file, digest, offset, length)))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
        if file is not None:
            file.close()

    fields = [f.strip().split(" ") for f in schema.split(",")]
    names = [n for n, _ in fields]
    types = [pa.string() if t == "string" else pa.int64() for _, t in fields]
    dealt = places.repartition("shard", F.floor(F.col("offset") / (64 << 20))).sortWithinPartitions("shard", "offset")
    return dealt.select("digest", "shard", "offset", "length").mapInArrow(each, schema)


def read_headers(places: DataFrame) -> DataFrame:
    """(digest, width, height, depth), reading HEADER_BYTES of each payload."""

    def head(file, digest: str, offset: int, length: int) -> tuple:
        file.seek(offset)
        return png_size(file.read(min(HEADER_BYTES, length)))

    return _ranged(places, head, "digest string, width bigint, height bigint, depth bigint")


def read_features(places: DataFrame) -> DataFrame:
    """Features of each stored payload, from the bytes read back: payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256 and feature. A payload
    whose digest differs from its address fails the job."""

    def whole(file, digest: str, offset: int, length: int) -> tuple:
        file.seek(offset)
        media = file.read(length)
        payload = from_png(media)
        found = hashlib.sha256(payload).hexdigest()
        if found != digest:
            raise ValueError(f"payload {digest} reads back as {found}")
        return (len(payload), found, zlib.crc32(payload[-64:]), length, hashlib.sha256(media).hexdigest(), feature_of(payload))

    return _ranged(places, whole, "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Store all payloads and return, per row of ``docs``, id, n_bytes, the
    columns of :func:`read_features`, the address (digest, shard, offset,
    length) and the metadata of :func:`read_headers`. For rows that are null,
    empty, long or repeated see :func:`store_payloads`."""
    manifest = store_payloads(docs, id_col, text_col, folder)
    places = written(addresses(manifest), "places")
    rows = manifest.select(id_col, "digest", "n_bytes")
    found = places.join(read_headers(places), "digest").join(read_features(places), "digest")
    features = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return rows.join(found, "digest").select(id_col, "n_bytes", *features, "digest", "shard", "offset", "length", "width", "height", "depth")
