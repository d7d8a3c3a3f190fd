import math
import re
import zlib
from collections import Counter

import numpy as np
from sievelake.llm import lm, queries

SCHEMA = "doc_id bigint, text string"


def brute(rows, order=lm.ORDER, strength=lm.STRENGTH):
    """The model by plain counting over words."""

    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]

    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    count, total = Counter(), 0
    for i, t in rows:
        if not held(i):
            w = ["<"] * (order - 1) + words(t)
            for k in range(order - 1, len(w)):
                total += 1
                for n in range(1, order + 1):
                    count[tuple(w[k - n + 1 : k + 1])] += 1
            for n in range(1, order):
                count[("<",) * n] += 1
    v = sum(1 for k in count if len(k) == 1 and k != ("<",))
    out = []
    for i, t in rows:
        w = ["<"] * (order - 1) + words(t)
        base = full = known = 0
        for k in range(order - 1, len(w)):
            c = count[(w[k],)]
            p = (c + 0.5) / (total + 0.5 * (v + 1))
            base += math.log10(p)
            known += c > 0
            for n in range(2, order + 1):
                h = count[tuple(w[k - n + 1 : k])]
                if h:
                    strong = strength[n - 2][0] + strength[n - 2][1] * h
                    p = (count[tuple(w[k - n + 1 : k + 1])] + strong * p) / (h + strong)
            full += math.log10(p)
        out.append((i, held(i), len(w) - order + 1, known, total, base, full))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9)


def test_small_cases(spark):
    texts = ["a b c a b", "A b\tc", None, "", "a a a a", "new words only", "b c a b c", "x", " \n ", "ü Ü a", "a b c a b"]
    rows = [(i, t) for i, t in enumerate(texts * 4)] + [(3, "a b c"), (None, "a b")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    same(lm.score_documents(df).collect(), brute(rows))
    strength = ((5.0, 0.5), (2.0, 1.0))
    same(lm.score_documents(df, order=3, strength=strength, buckets=7).collect(), brute(rows, 3, strength))
    strength = ((5.0, 0.5), (2.0, 1.0), (0.5, 1.5))
    same(lm.score_documents(df, order=4, strength=strength).collect(), brute(rows, 4, strength))
    assert lm.score_documents(df.limit(0)).collect() == []


def test_packing_round_trips():
    rng = np.random.default_rng(0)
    for n in (1, 2, 500):
        keys = np.unique(rng.integers(0, 1 << 56, n, dtype=np.uint64))
        assert (lm.unpacked_keys(lm.packed_keys(keys)) == keys).all()
    near = np.arange(10**6, 10**6 + 300, dtype=np.uint64)
    assert (lm.unpacked_keys(lm.packed_keys(near)) == near).all()
    for c in ([0], [255, 1], [256], [1 << 40, 3], [(1 << 64) - 1]):
        assert lm.unpacked(lm.packed(np.array(c, np.uint64), 8), 8).tolist() == c


def walk(model, words, sizes):
    """The automaton read one word at a time, arcs looked up in dictionaries."""
    arcs = [{int(k): (w, d) for k, w, d in zip(*a)} for a in model.arcs]
    level = lambda s: sum(s >= b for b in model.base.tolist()) - 1
    out, at = [], 0
    for n in sizes:
        state = model.start()
        for w in words[at : at + n]:
            weight = 0.0
            while True:
                k = level(state)
                key = (state - int(model.base[k])) * model.kinds + int(w)
                if key in arcs[k]:
                    weight, state = weight + arcs[k][key][0], int(arcs[k][key][1])
                    break
                weight, state = weight + model.fail_weight[state], int(model.fail[state])
            out.append(weight)
        at += n
    return out


def test_texts_side_by_side_are_read_as_one_by_one(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 12, n)).encode() for n in (0, 1, 2, 3, 40, 7, 90, 33)]
    hashes = [lm.words_of(t) for t in texts]
    types, words = np.unique(np.concatenate(hashes), return_inverse=True)
    sizes = np.array([len(h) for h in hashes])
    for order in (2, 3, 4):
        every = lm.grams(words, types, sizes, order)
        train = np.repeat([True, False, True, True, True, True, False, True], sizes)
        counts = [np.bincount(g.ends, train, len(g.keys)).astype(np.int64) for g in every]
        model = lm.Automaton(every, counts, 6, int(train.sum()), int((counts[0] > 0).sum()), ((4.0, 2.0), (1.0, 1.0), (1.0, 0.5)))
        want = walk(model, words, sizes)
        for run in (1, 5, 512):
            monkeypatch.setattr(lm, "RUN", run)
            assert np.allclose(model.read(words, sizes), want, rtol=1e-12)


def test_counts_over_255_and_long_texts(spark):
    rows = [(0, "w " * 30_000), (2, "w v " * 300), (3, "w")]
    same(lm.score_documents(spark.createDataFrame(rows, SCHEMA)).collect(), brute(rows))


def test_table_and_held_out_gain(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op5_lm_scoring(spark, sf).collect()
    same(got, brute(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
