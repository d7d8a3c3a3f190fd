import math

import numpy as np
from sievelake.llm import queries, vectordup

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, threshold=0.95):
    good = []
    for i, v, *_ in rows:
        if v is None or None in v or not all(map(math.isfinite, v)) or not any(v):
            continue
        x = np.array([np.float32(c) for c in v], np.float64)
        good.append((i, x / np.sqrt((x * x).sum())))
    comp = {i: i for i, *_ in rows}
    links = [(a, b) for a, x in good for b, y in good if a != b and len(x) == len(y) and x @ y >= threshold]
    n = {i: 0 for i in comp}
    for a, _ in links:
        n[a] += 1
    while True:
        old = dict(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == old:
            return {i: (n[i], comp[i], comp[i] == i) for i in comp}


def found(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_small_cases(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(30):
        base = rng.normal(size=16)
        for _ in range(1 + k % 4):
            rows.append((len(rows), [float(np.float32(x)) for x in base + rng.normal(size=16) * 0.03], k))
    rows += [(200, rows[0][1], 1), (201, rows[0][1], 2), (202, [2 * x for x in rows[0][1]], 3)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] + [1.0] * 15, 1), (303, [None] + [1.0] * 15, 1), (304, [], 1), (305, [1.0, 2.0], 1), (306, [1.0, 2.0], None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(vectordup.near_duplicate_vectors(df)) == brute(rows)
    assert vectordup.near_duplicate_vectors(df.limit(0)).collect() == []


def test_blocks_of_a_hot_list(spark, monkeypatch):
    monkeypatch.setattr(vectordup, "BLOCK", 40)
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(i, [float(np.float32(x)) for x in base + rng.normal(size=8) * 0.02], 0) for i in range(150)]
    assert found(vectordup.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_recall_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, got = brute(rows), found(queries.op10_embedding_near_dedup(spark, sf))
    links = sum(n for n, *_ in want.values())
    assert sum(min(got[i][0], want[i][0]) for i in want) >= 0.9 * links  # recall
    assert all(got[i][0] <= want[i][0] for i in want)  # nothing below the threshold


def test_null_and_repeated_ids(spark):
    near = lambda x, y: [x, y, 0.0, 0.0]
    rows = [(5, near(1.0, 0.05), 0), (None, near(1.0, 0.0), 0), (6, [0.0, 0.0, 1.0, 0.05], 0), (None, [0.0, 0.0, 1.0, 0.0], 0)]
    rows += [(9, [1.0, -1.0, 1.0, -1.0], 0), (9, [1.0, 1.0, 1.0, 1.0], 0), (8, [1.0, 1.0, 1.0, 1.01], 0)]  # one id, two vectors
    rows += [(None, [-1.0, 1.0, 1.0, 1.0], 0), (None, [-1.0, 1.0, 1.0, 1.0], 0)]  # a component without ids
    got = vectordup.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [(5, 1, 5, True), (None, 1, 5, None), (6, 1, 6, True), (None, 1, 6, None), (9, 0, 9, True), (9, 1, 8, False), (8, 1, 8, True), (None, 1, None, None), (None, 1, None, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_recall_of_links_and_components_near_the_threshold(spark):
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(700):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        rows.append(x)
        for c in rng.uniform(0.9501, 0.97, int(rng.integers(0, 4))):
            z = rng.normal(size=64)
            z -= (z @ x) * x
            rows.append(c * x + np.sqrt(1 - c * c) * z / np.linalg.norm(z))
    rows = [(i, [float(np.float32(v)) for v in x], 0) for i, x in enumerate(rows)]
    df = spark.createDataFrame(rows, SCHEMA)
    want, got = brute(rows), found(vectordup.near_duplicate_vectors(df))
    links = sum(n for n, *_ in want.values())
    assert links > 1000 and all(got[i][0] <= want[i][0] for i in want)
    recall = sum(got[i][0] for i in want) / links
    same = sum(got[i][1] == want[i][1] for i in want) / len(want)
    print(recall, same)
    assert recall >= 0.97 and same >= 0.95
