import random
import re

import numpy as np
from sievelake.llm import neardup

SCHEMA = "doc_id bigint, text string"


def brute(rows, width=2, percent=80):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x20\x09-\x0D]+", low)

    sets = []
    for i, t in rows:
        w = words(t)
        k = min(width, len(w))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()))
    comp = {i: i for i, _ in sets}
    links = [(a, b) for a, x in sets for b, y in sets if a < b and x and y and 100 * len(x & y) >= percent * len(x | y)]
    while True:
        old = dict(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == old:
            break
    return {i: (len(s), comp[i], comp[i] == i) for i, s in sets}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = rng.choices(vocab, k=rng.choice([1, 2, 3, 8, 40, 150]))
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((n, rng.choice([" ", "\n", "\t "]).join(w).replace("w1", rng.choice(["w1", "W1"]))))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one"), (n + 4, "ONE ")]
    assert found(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), width=2)) == brute(rows)


def test_chain_is_one_component(spark):
    words = [f"x{i}" for i in range(200)]
    rows = [(100 - k, " ".join(words[k * 8 : k * 8 + 120])) for k in range(10)]
    assert found(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=2)) == brute(rows)


def test_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert neardup.near_duplicates(empty).collect() == []
    rows = [(3, "a b c", 1), (1, "A b\nc", 2), (1, "a b c", 3), (None, "a b c", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    out = neardup.near_duplicates(df, width=2).collect()
    assert sorted((r.component_id for r in out)) == [1, 1, 1, 1] and len(out) == 4
    assert {r.kept for r in out if r.doc_id == 1} == {True}
    assert {r.kept for r in out if r.doc_id is None} == {None}
    assert [r.doc_id for r in neardup.one_per_group(df, width=2).collect()] == [1]


def test_one_id_with_several_texts(spark):
    """Links join texts, not ids: each class keeps its own name."""
    a, b = ([f"{x}{i}" for i in range(40)] for x in "ab")
    near = lambda w, k: " ".join([*w[:-1], f"z{k}"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (5, near(a, 1)), (6, near(b, 2)), (7, near(b, 3)), (7, "something else entirely")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), width=2).collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out)
    assert got == [(1, 39, 1, True), (1, 39, 1, True), (5, 39, 1, False), (6, 39, 1, False), (7, 2, 7, True), (7, 39, 1, False)]


def test_blocks_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 300)
    rng = random.Random(9)
    rows = []
    for n in range(40):
        w = [f"b{i}" for i in range(60 + n // 3)]
        for i in rng.sample(range(60), rng.choice([1, 2, 3, 4])):
            w[i] = f"n{n}x{i}"
        rows.append((n, " ".join(w)))
    assert found(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), width=2)) == brute(rows)


def test_long_text(spark):
    long = " ".join(f"t{i % 5000}x{i % 37}" for i in range(60_000))
    out = found(neardup.near_duplicates(spark.createDataFrame([(1, long), (2, long + " more")], SCHEMA), width=2))
    assert out[2][1] == 1 and out[1][0] == out[2][0] - 1


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = x[:2400], x[600:]
    assert (np.maximum(neardup.registers(a), neardup.registers(b)) == neardup.registers(x)).all()
    ra, rb = (np.stack([neardup.registers(s)]) for s in (a, b))
    best, short = neardup.similarity_likelihood(ra, rb, np.array([2400.0]), np.array([2400.0]), 0.8)
    assert abs(best[0] - 1800 / 3000) < 0.08 and short[0] > neardup.RULED_OUT
    ra, rb = (np.stack([neardup.registers(s)]) for s in (x[:2700], x[300:]))
    best, short = neardup.similarity_likelihood(ra, rb, np.array([2700.0]), np.array([2700.0]), 0.8)
    assert short[0] < neardup.RULED_OUT


def test_blocks_of_a_large_group(spark, monkeypatch):
    """A family of near copies that are not all alike, in blocks of 20."""
    monkeypatch.setattr(neardup, "BLOCK", 20)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for n in range(90):
        w = list(base)
        for i in rng.sample(range(60), rng.choice([1, 2, 3, 4])):
            w[i] = f"n{n}x{i}"
        rows.append((n, " ".join(w)))
    assert found(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), width=2)) == brute(rows)


def test_quick_test_drops_only_what_the_likelihood_drops():
    rng = np.random.default_rng(3)
    for share in (0.6, 0.7, 0.75, 0.8, 0.9):
        x = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        k = int(400 * 2 * share / (1 + share))
        y = np.concatenate([x[:k], rng.integers(0, 1 << 63, 400 - k).astype(np.uint64)])
        a, b = (np.stack([neardup.registers(s)]) for s in (x, y))
        n = np.array([400.0])
        _, short = neardup.similarity_likelihood(a, b, n, n, 0.8)
        quick = neardup._plausible(n, n, (a == b).sum(1), 0.8)[0]
        assert quick or short[0] > neardup.RULED_OUT
        assert share < 0.8 or short[0] <= neardup.RULED_OUT


def test_components_get_fewer_links_than_documents(spark, monkeypatch):
    """Near copies that meet in many bands: components join over their links."""
    rng = random.Random(4)
    rows = []
    for n in range(160):
        w = [f"b{i}" for i in range(150)]
        for i in rng.sample(range(150), rng.choice([1, 2, 3])):
            w[i] = f"n{n}x{i}"
        rows.append((n, " ".join(w)))
    given, components = [], neardup.components

    def counted(links):
        given.append(links.count())
        return components(links)

    monkeypatch.setattr(neardup, "components", counted)
    assert found(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), width=2)) == brute(rows)
    assert sum(given) < len(rows), given


def test_joined_names_components_by_their_smallest(spark):
    labels = spark.createDataFrame([(1, 1), (4, 1), (2, 2), (5, 2), (6, 6), (7, 6)], "v bigint, label bigint")
    links = spark.createDataFrame([(4, 5), (5, 4), (1, 4), (8, 9), (3, 7)], "a bigint, b bigint")
    got = {r.v: r.label for r in neardup._joined(labels, links).collect()}
    assert got == {1: 1, 4: 1, 2: 1, 5: 1, 6: 3, 7: 3, 3: 3, 8: 8, 9: 8}
