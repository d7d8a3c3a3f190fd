import re
import zlib

import corpus_pipeline
import numpy as np
from sievelake.llm import langid, mixing, neardup, secrets, tokens


def test_pipeline_against_brute_force(spark, sf):
    """Each stage on its predecessor's rows, done plainly on the driver."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    models = langid.fit_models(langid.training_sample(docs, "doc_id", "text", "lang", corpus_pipeline.LANGID_SAMPLE))
    rows = []
    for r in docs.collect():
        cost, n = langid.doc_cost(models, r.text or "")
        best, _, far = models.judge(cost[None], np.array([n]))
        if n and not far[0]:
            rows.append((r.doc_id, r.text, models.langs[best[0]], r.source, r.n_chars))
    assert len(rows) >= 0.98 * docs.count()

    def shingle(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = [(r[0], shingle(r[1])) for r in rows]
    comp = {i: i for i, _ in sets}
    links = [(a, b) for a, x in sets for b, y in sets if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    for _ in range(len(rows)):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    rows = [r for r in rows if comp[r[0]] == r[0]]
    clean = []
    for i, t, lang, source, n in rows:
        spans = secrets.base_spans(t)
        spans = spans + secrets.linked_spans(t, spans)
        new = secrets.redacted(t, spans)
        clean.append((i, new, lang, source, len(new) if spans else n))
    df = spark.createDataFrame(clean, docs.schema)
    mixed = mixing.mix_sources(df).select("doc_id", "text").collect()
    words = tokens.WordTokenizer.of(tokens.default_tokenizer())
    size = words.dtype.itemsize
    want = {}
    for i, t in mixed:
        want.setdefault(i, [0, t])[0] += 1
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(want)
    for i, (copies, t) in want.items():
        ids = np.frombuffer(words.encode([t.encode()])[0], words.dtype).astype("<u4")
        assert sum(r.length for r in got[i]) == copies * len(ids) and size
        cover = np.zeros(len(ids), int)
        for r in got[i]:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            cover[r.start : r.start + r.length] += 1
        assert (cover == copies).all()


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


WORDS = {"en": "the of and to in a is that it was for on are as with his they at be this".split(), "de": "der die und das ist nicht sie ein ich mit dem auf den für im zu von sich auch".split()}


def odd_rows():
    text = lambda lang, k: " ".join(WORDS[lang][(i * (k + 1) + i // 7 + k * k) % 19] for i in range(40 + k % 9))
    rows = [(i, text(lang, i), lang, f"s{i % 3}", 1) for i in range(30) for lang in WORDS]
    rows += [rows[3], rows[3], (None, rows[3][1], None, None, None), (None, None, None, None, None), (70, None, "en", "s1", None), (71, "", "en", "empty", 0), (71, "", "en", "empty", 0)]
    rows += [(72, "123 456", None, "s1", 7), (73, "password=abcdefgh12 " + text("en", 5), "en", None, 9), (74, " ".join([text("de", 3)] * 400), "de", "s2", 1)]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_take_odd_rows(spark, sf):
    rows = odd_rows()
    plain = spark.createDataFrame(rows, SCHEMA).repartition(3)
    names = ["lang_pred", "score", "rejected", "copy_no", "mix_key", "spans", "component_id", "kept", "window", "_sl_count", "n", "sig", "rep", "label"]
    wide = plain.selectExpr("*", *[f"cast(doc_id as string) as {c}" for c in names])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, plain, sf).collect()
        again = stage(spark, wide.repartition(5), sf)
        if name == "packing":
            assert sum(r.length for r in out) == sum(r.length for r in again.collect()) and {r.doc_id for r in out} == {r[0] for r in rows}
        else:
            assert again.columns == [f.split()[0] for f in SCHEMA.split(", ")]
            assert sorted(map(str, map(tuple, out))) == sorted(map(str, map(tuple, again.collect())))
        assert stage(spark, plain.limit(0), sf).collect() == []
        got = [r.doc_id for r in out]
        if name == "language_id":
            assert not {70, 71, 72} & set(got) and got.count(rows[3][0]) == 4 and got.count(None) == 1 and 74 in got
        if name == "near_dedup":
            assert got.count(70) == got.count(71) == got.count(72) == 1 and [r.text for r in out if r.doc_id is None] == [None]
        if name == "secret_scans":
            assert len(out) == len(rows) and [r.text[:9] for r in out if r.doc_id == 73] == ["[secret] "]
        if name == "mixing":
            assert {r.source for r in out} <= {None, "s0", "s1", "s2"}


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    for i, rows in enumerate((odd_rows(), [])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{i}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{i}").collect()
        assert bool(out) == bool(rows) and all(r.length > 0 for r in out)
