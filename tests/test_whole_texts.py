"""Queries that see whole texts, not their first characters."""

import hashlib

from sievelake.operators import reduce as R
from sievelake.plans import detect_queries, select_queries, text_queries


def plain_simhash(text):
    low = text.lower()
    votes = [0] * 64
    for g in [low[i : i + 4] for i in range(max(1, len(low) - 3))]:
        h = int.from_bytes(hashlib.blake2b(g.encode("utf-8", "replace"), digest_size=8).digest(), "big")
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(64) if votes[b] > 0)


def test_simhash_and_class_of_whole_texts(spark, tmp_path):
    head = "The same license header. " * 20
    rows = [(3, head + "alpha beta gamma " * 30), (7, head + "other words entirely, 42 of them " * 40), (11, head + "<p> <b> <i>"), (15, None), (19, ""), (23, "Äö")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.simhash for r in select_queries.q_simhash(spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else plain_simhash(t) - (1 << 63) for i, t in rows} and got[3] != got[7]
    cls = {r.doc_id: r.cls for r in detect_queries.q_cell_class(spark, str(tmp_path)).collect()}
    assert cls[11] == "html" and cls[7] == "long"


def test_simhash_as_plain():
    assert R.simhash("abababababab") != R.simhash("ababa")  # every window votes
    for t in ("", "a", "abcd", "\ud800x\ud800yz", "words " * 50 + "ß"):
        assert R.simhash(t) == plain_simhash(t)


def test_tags_wrap_whole_texts(spark, tmp_path):
    text = "x" * 500
    spark.createDataFrame([(1, 0, text), (1, 1, None), (1, 2, "short")], "conv_id bigint, turn bigint, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.id: (r.blocks, r.restored, r.clean_chars) for r in text_queries.q_tags(spark, str(tmp_path)).collect()}
    assert set(got) == {"1/0", "1/2"} and all(r[:2] == (1, True) for r in got.values())
    assert got["1/0"][2] - got["1/2"][2] == 470
