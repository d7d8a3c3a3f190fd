import zlib
from collections import defaultdict

import numpy as np
import pytest
from sievelake.llm import bestfit, packing, queries, tokens

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id bigint, text string, source string"


@pytest.fixture(scope="module")
def direct():
    t = tokenizers.Tokenizer.from_file(tokens.default_tokenizer())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


ODD = [None, "", "  ", "Hello, World's  end", "naïvé é ́x", "a b c\x1cd", "<|endoftext|> x <|startoftext|>y", "<|ENDOFTEXT|> Up", "ΑΣ ΣΑΣ ß İ", "日本語 テスト", "it's we'll '' 12 3.5", "word " * 9000, "\x00\x85z", "Été, Ça! Über-groß naïve.. İx Kelvin Å a\u0301b can't x-y -- (foo) \"q\" a.b"]


def test_word_cache_equals_whole_texts(direct):
    words = tokens.WordTokenizer(tokens.default_tokenizer())
    for _ in range(2):  # the second time from the cache
        for text, data in zip(ODD, words.encode([None if t is None else t.encode() for t in ODD])):
            assert np.frombuffer(data, words.dtype).tolist() == direct(text)


def check_pieces(rows, texts, direct, length=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids, at = np.array(direct(texts[doc]), "<u4"), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        total += at
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding <= 0.01 * total


def test_mixture_round_trip(spark, direct):
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(ODD)] + [(50, "null source", None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    check_pieces(packing.pieces_of(packing.pack_mixture(df)).collect(), {r[0]: r[1] for r in rows}, direct)
    assert packing.pack_mixture(df.limit(0)).collect() == []


def test_mixture_on_the_table(spark, sf, direct):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    check_pieces(queries.op4_packing(spark, sf).collect(), texts, direct)


def test_windows_follow_the_targets(spark):
    rows = [(i, "one two three four five " * 20, "abc"[i % 3]) for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = packing.pack_mixture(df, weights={"a": 2.0, "b": 1.0, "c": 1.0}, length=256).collect()
    used = defaultdict(lambda: [0, 0, 0])
    for r in out:
        for s in r.segments:
            used[r.window][s.source_no] += s.length
    full = packing.WINDOW * 256
    early = [w for w in used if w < 0.4 * len(used)]
    assert len(early) > 3
    for w in early:
        assert sum(used[w]) == full
        assert [abs(x - full * t) <= 2 for x, t in zip(used[w], (0.5, 0.25, 0.25))] == [True] * 3


def test_repeated_rows_are_packed_again(spark):
    df = spark.createDataFrame([(1, "a b", "s")] * 5 + [(None, "c", "s")], SCHEMA)
    out = packing.pieces_of(packing.pack_mixture(df)).collect()
    assert sum(r.length for r in out) == 5 * 3 + 2 and {r.doc_id for r in out} == {1, None}


def test_schedule_is_exact():
    s = packing.Schedule([1000, 0, 37, 5], [1.0, 5.0, 1.0, 0.0], 64)
    assert s.before(0) == [0, 0, 0, 0] and s.before(s.windows) == [1000, 0, 37, 5]
    for w in range(s.windows):
        assert sum(s.before(w)) == w * 64


def test_best_fit_and_round_trip(spark, sf, direct):
    rng = np.random.default_rng(0)
    for _ in range(30):
        cap = int(rng.integers(1, 70))
        sizes = rng.integers(1, cap + 1, int(rng.integers(0, 60))).tolist()
        packed, rooms = bestfit.best_fit(sizes, cap), []
        assert sorted(k for s in packed for k in s) == list(range(len(sizes)))
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):  # brute force
            fit = [i for i, r in enumerate(rooms) if r >= sizes[k]]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= sizes[k]
            else:
                rooms.append(cap - sizes[k])
        assert sorted(rooms) == sorted(cap - sum(sizes[k] for k in s) for s in packed)
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got, total, rows = defaultdict(dict), 0, queries.op7_token_binary(spark, sf).collect()
    matrices = {f: np.fromfile(f.removeprefix("file://"), "<u2").reshape(-1, 2048) for f in {r.file for r in rows}}
    assert sum(map(len, matrices.values())) == len(rows) == len({(r.file, r.row) for r in rows})
    for r in rows:
        ids = matrices[r.file][r.row]
        assert not ids[r.n_tokens :].any() and r.cu_seqlens[-1] == r.n_tokens and r.id_bytes == 2 and r.ids_crc32 == zlib.crc32(ids.tobytes())
        assert r.position_resets == [b for b, s in zip(r.cu_seqlens, r.starts) if s == 0]
        total += r.n_tokens
        for k, (d, s) in enumerate(zip(r.doc_ids, r.starts)):
            got[d][s] = ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()
    for d, t in texts.items():
        assert [x for s in sorted(got[d]) for x in got[d][s]] == direct(t)
    assert total >= 0.97 * 2048 * len(rows)


def test_best_fit_edge_cases(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (2, "", "s"), (None, "x " * 5000, None)], SCHEMA)
    rows = sorted(bestfit.pack_best_fit(df, length=64).collect(), key=lambda r: r.sequence_id)
    assert sum(r.n_tokens for r in rows) == 3 + 5001
    assert bestfit.pack_best_fit(df.limit(0)).collect() == []
    packed = bestfit.pack_best_fit(df, length=64)
    files = bestfit.write_matrices(packed, f"file://{tmp_path}/m", 64).collect()
    for r, f in zip(rows, sorted(files, key=lambda f: f.sequence_id)):
        row = np.fromfile(f.file.removeprefix("file://"), f"<u{f.id_bytes}").reshape(-1, 64)[f.row]
        assert row.tobytes() == r.ids and (f.sequence_id, f.cu_seqlens, f.starts) == (r.sequence_id, r.cu_seqlens, r.starts)
    assert bestfit.write_matrices(packed.limit(0), f"file://{tmp_path}/none", 64).collect() == [] and not (tmp_path / "none").exists()
    long = max(rows, key=lambda r: r.starts[0])
    assert long.position_resets == [] and long.cu_seqlens == [0, 9]  # the rest of the long text goes on from its start


def plain_rounds(queues, weights, room, length):
    """Deficit round-robin window by window, deficits carried along: sources are
    due their shares, get whole tokens, and are owed the rest."""
    supply, taken = [sum(q) for q in queues], [0] * len(queues)
    deficit, out = [0.0] * len(queues), []
    while sum(taken) < sum(supply):
        left, due = min(room, sum(supply) - sum(taken)), [0.0] * len(queues)
        at = [t + d for t, d in zip(taken, deficit)]  # what was due so far
        while left > 1e-9:
            live = [i for i in range(len(queues)) if supply[i] - at[i] - due[i] > 1e-6]
            if not live:
                break
            total = sum(weights[i] for i in live)
            step = min([left] + [(supply[i] - at[i] - due[i]) * total / weights[i] for i in live if weights[i] > 0])
            for i in live:
                due[i] += step * weights[i] / total
            left -= step
        out.append((due, list(deficit)))
        cumulative = done = 0
        target = [a + d for a, d in zip(at, due)]
        new = []
        for t in target:
            cumulative += t
            new.append(round(cumulative + 1e-9) - done)
            done = round(cumulative + 1e-9)
        deficit, taken = [t - n for t, n in zip(target, new)], new
    return out


def test_deficits_are_carried_from_window_to_window():
    rng = np.random.default_rng(2)
    for _ in range(20):
        k = int(rng.integers(1, 6))
        supply = rng.integers(1, 5000, k).tolist()
        weights = rng.uniform(0.2, 5, k).tolist()
        s = packing.Schedule(supply, weights, 320)
        want = plain_rounds([[n] for n in supply], weights, 320, 32)
        assert len(want) == s.windows
        for w, (due, deficit) in enumerate(want):
            assert np.allclose([b - a for a, b in zip(s.target(w), s.target(w + 1))], due, atol=1.5)
            assert np.allclose(s.deficits(w), deficit, atol=1.5) and abs(sum(s.deficits(w))) < 1e-6
            assert all(abs(d) < 2 for d in s.deficits(w))


def test_rounds_start_from_what_is_owed():
    queue = lambda n: [(i, 0, 10, [0] * 10) for i in range(n)]
    served = packing.serve({0: queue(4), 1: queue(4)}, {0: 40.0, 1: 40.0}, {0: -15.0, 1: 0.5}, 20)
    plain, deficit, left = [], {0: -15.0, 1: 0.5}, {0: 4, 1: 4}
    while any(left.values()):
        for s in (0, 1):
            if left[s]:
                deficit[s] += 10
                while deficit[s] > 0 and left[s]:
                    plain.append(s)
                    deficit[s] -= 10
                    left[s] -= 1
    assert [s for s, *_ in served] == plain


def test_many_sources_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_SOURCES", 3)
    df = spark.createDataFrame([(i, "x", f"s{i}") for i in range(5)], SCHEMA)
    with pytest.raises(ValueError):
        packing.pack_mixture(df)
