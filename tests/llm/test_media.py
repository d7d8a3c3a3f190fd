import hashlib
import io
import tarfile
import zlib

from pyspark.sql import functions as F
from sievelake.llm import media

SCHEMA = "doc_id bigint, text string"


def test_round_trip_and_digests(spark):
    texts = [None, "", "a", "ü" * 32, "x" * 64, "same", "same", "long " * 50_000, "\0", "new\nline"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    out = {r.doc_id: r for r in media.media_columns(df).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        n = max(1, -(-len(raw) // 64)) * 64
        payload = raw + b"\0" * (n - len(raw))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), n) and r.height == n // 64
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() == r.digest
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        stored = media.to_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == media.feature_of(payload)
    assert out[5].feature == out[6].feature and out[0].payload_sha256 == out[1].payload_sha256


def test_shards_are_tars_and_headers_are_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "d" * 1000), (None, "z")], SCHEMA).coalesce(1)
    manifest = media.store_payloads(df, folder=f"file://{tmp_path}/shards")
    places = media.addresses(manifest)
    (shard,) = (tmp_path / "shards").iterdir()
    with tarfile.open(fileobj=io.BytesIO(shard.read_bytes())) as tar:
        names = [m.name for m in tar.getmembers()]
        assert len(names) == 3 and all(media.from_png(tar.extractfile(n).read()) for n in names)
    assert {(r.width, r.height, r.depth) for r in media.read_headers(places).collect()} == {(64, 1, 8), (64, 16, 8)}
    assert {(r.doc_id) for r in manifest.collect()} == {1, 2, 3, None}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA + ", digest int")
    assert media.media_columns(df).collect() == []


def test_feature_by_plain_numbers():
    import numpy as np

    for raw in (b"\0" * 64, bytes(range(256)), b"some text, " * 30 + b"\0" * 22):
        x = np.frombuffer(raw, np.uint8).astype(float)
        bins = ",".join(str(int(1000 * ((x >= 32 * k) & (x < 32 * k + 32)).sum() // len(x))) for k in range(8))
        mean, spread, hist = media.feature_of(raw).split("|")
        assert abs(float(mean) - x.mean()) < 1e-3 and abs(float(spread) - x.std()) < 1e-3 and hist == bins


def test_damaged_payloads_fail(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([(1, "abc" * 100), (2, "other " * 50)], SCHEMA).coalesce(1)
    places = media.addresses(media.store_payloads(df, folder=f"file://{tmp_path}/shards"))
    (shard,) = (tmp_path / "shards").iterdir()
    at = places.first()
    data = bytearray(shard.read_bytes())
    data[at.offset + 50] ^= 1
    shard.write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged|reads back"):
        media.read_features(places).collect()
    swapped = places.withColumn("digest", F.lit("0" * 64))
    with pytest.raises(Exception, match="damaged|reads back"):
        media.read_features(swapped).collect()


def test_contract_comes_first(spark, sf):
    from sievelake.llm import queries

    out = queries.op2_media_columns(spark, sf)
    assert out.columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert out.where("offset % 512 != 0 or length != media_bytes or width != 64 or 64 * height != payload_bytes or depth != 8").count() == 0
