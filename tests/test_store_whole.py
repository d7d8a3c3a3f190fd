"""The set and store queries over whole tables, against plain Python."""

from sievelake.plans import store_queries as Q
from sievelake.plans.store_rows import NOW


def test_intersection_pairs_all_neighbours(spark, tmp_path):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 5, i % 5 + 3 + i % 2))) for i in range(38, 60)] + [(70, "alone")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = {i: set(t.split()) for i, t in rows}
    want = {(i, len(w & words[i + 1]), round(len(w & words[i + 1]) / len(w | words[i + 1]), 6)) for i, w in words.items() if i + 1 in words}
    assert set(map(tuple, Q.q_intersection(spark, str(tmp_path)).collect())) == want and len(want) == 21


def test_store_loads_every_live_entry(spark, sf):
    got = Q.q_src_store(spark, sf).collect()
    ids = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    want = sum((i * 7) % 20000 <= (600 if i % 5 == 0 else 7200) for i in ids)
    assert len(got) == want > 50
    assert got == sorted(got, key=lambda r: (-r.created_at, r.hash_key)) and all(r.created_at <= NOW for r in got)
