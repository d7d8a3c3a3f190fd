"""Language identification by interpolated Kneser-Ney character models.

One model per language over the letters of words (a word's boundaries count as
letters). All models share one sorted array of n-gram hashes with a column of
log-probabilities per language, so a lookup answers for every language at once.
A document gets the language with the lowest cross-entropy per letter; its
score is a calibrated posterior, and documents whose best cross-entropy lies
far above what the language's own training texts show are marked as rejected.

The models are fitted on a bounded sample: about ``per_language`` whole
documents of each language, picked by a hash of their id (a documented
parameter). Prediction reads whole texts of all rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import claim_cache, keeps_cache, ready

ORDER, DISCOUNT, EDGE = 5, 0.75, 0x1F
#: A document is rejected when its best cross-entropy a letter, in log10 units,
#: lies this far above the language's median: its letters are on average four
#: times less likely than the language's own.
REJECT_BY = 0.6
#: The share of a language's documents that its limit lies above in any case.
NEARLY_ALL = 0.95
#: Labels that may be learned; each adds a column to the broadcast models.
MAX_LANGUAGES = 500
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(29), np.uint64(32))
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Letters of a token with digits (keys, identifiers, addresses) are hardly of a
#: language: they count this much, so they decide only where nothing else does.
DIGIT, DIGIT_WEIGHT = re.compile(r"\d"), 1 / 64


def _hash_grams(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of code points; the width is part of the hash."""
    h = np.full(len(codes), codes.shape[1] + 1, np.uint64) * _MIX[1]
    for k in range(codes.shape[1]):
        h = (h ^ codes[:, k].astype(np.uint64)) * _MIX[0]
        h ^= h >> _MIX[2]
    return h ^ (h >> _MIX[3])


def letters(token: str) -> list[str]:
    """The runs of letters of a token, in lower case."""
    low = token.lower()
    return [low] if low.isalpha() else [w for w in NOT_LETTERS.split(low) if w and any(c.isalpha() for c in w)]


def _grid(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of EDGE*4 + word + EDGE for all words in one array, and the
    positions (word numbers) of predicted characters; -1 where none is."""
    pad = chr(EDGE) * (ORDER - 1)
    text = "".join(pad + w + chr(EDGE) for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + ORDER
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    owner[np.arange(len(codes)) - starts < ORDER - 1] = -1
    return codes, owner


@dataclass
class CharModels:
    """Sorted n-gram hashes with a log10 probability per language, and per
    context hash the log10 weight that failing it costs."""

    langs: list[str]
    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray
    floor: np.ndarray
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: float = 1.0

    def word_costs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Minus log10 probability per word and language; letters predicted."""
        codes, owner = _grid(words)
        at = np.flatnonzero(owner >= 0)
        cost = np.zeros((len(at), len(self.langs)), np.float32)
        left = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            window = np.stack([codes[at[left] - n + 1 + k] for k in range(n)], 1)
            h = _hash_grams(window)
            i = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
            hit = self.grams[i] == h
            cost[left[hit]] -= self.logp[i[hit]]
            left, window = left[~hit], window[~hit]
            if not len(left):
                break
            if n > 1:
                h = _hash_grams(window[:, :-1])
                i = np.minimum(np.searchsorted(self.contexts, h), len(self.contexts) - 1)
                seen = self.contexts[i] == h
                cost[left[seen]] -= self.backoff[i[seen]]
            else:
                cost[left] -= self.floor
        out = np.zeros((len(words), len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner[at], cost[:, k], len(words))
        return out, np.bincount(owner[at], minlength=len(words))

    def judge(self, cost: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language number, score and rejection from costs of documents."""
        mean = cost / np.where(size > 0, size, 1)[:, None]
        best = mean.argmin(1)
        gap = (mean - mean.min(1)[:, None]) * self.scale * np.minimum(size, 200)[:, None]
        score = 1 / np.exp(-np.minimum(gap, 600) * np.log(10)).sum(1)
        return best, score, mean.min(1) > self.limits[best] if len(self.limits) else np.zeros(len(best), bool)


def held_back(texts: list[str]) -> tuple[list[str], list[str]]:
    """Texts to fit on, and the fifth by checksum that limits are set by. Where
    either would be empty, all texts serve for both."""
    back = [zlib.crc32(t.encode("utf-8", "replace")) % 5 == 0 for t in texts]
    if all(back) or not any(back):
        return texts, texts
    return [t for t, b in zip(texts, back) if not b], [t for t, b in zip(texts, back) if b]


def fit_models(texts: dict[str, list[str]]) -> CharModels:
    """Kneser-Ney models of the given texts, per language, then calibration on
    texts that were held back: a language's rejection limit lies REJECT_BY above
    the median cross-entropy of its documents and above nearly all of them, so
    that documents with foreign passages, numbers or keys stay, while a few junk
    documents under its label do not lift the limit."""
    langs = sorted(texts)
    if not langs:
        z = np.zeros(1, np.uint64)
        return CharModels([], z, np.zeros((1, 0), np.float32), z, np.zeros((1, 0), np.float32), np.zeros(0, np.float32))
    counted, tried = {}, {}
    for lang in langs:
        words = Counter()
        fitted, tried[lang] = held_back(texts[lang])
        for t in fitted:
            for token, n in Counter(t.split()).items():
                for w in () if DIGIT.search(token) else letters(token):
                    words[w] += n
        counted[lang] = words
    tables = {lang: _tables(w) for lang, w in counted.items()}
    alphabet = len(set("".join("".join(w) for w in counted.values()))) + 2
    floor = np.full(len(langs), -np.log10(alphabet) - 2, np.float32)
    grams = np.unique(np.concatenate([h for t in tables.values() for h, _ in t["grams"]]))
    contexts = np.unique(np.concatenate([t["contexts"][0] for t in tables.values()]))
    logp = np.zeros((len(grams), len(langs)), np.float32)
    backoff = np.zeros((len(contexts), len(langs)), np.float32)
    for k, lang in enumerate(langs):
        h, b = tables[lang]["contexts"]
        backoff[np.searchsorted(contexts, h), k] = b
    for k, lang in enumerate(langs):
        logp[:, k] = _flatten(tables, lang, langs, grams, contexts, backoff[:, k], floor[k])
    models = CharModels(langs, grams, logp, contexts, backoff, floor)
    limits, gaps = [], []
    for k, lang in enumerate(langs):
        costs = np.array([c / max(n, 1) for c, n in (doc_cost(models, t) for t in tried[lang]) if n])
        own = costs[:, k] if len(costs) else np.zeros(1)
        limits.append(max(np.median(own) + REJECT_BY, np.quantile(own, NEARLY_ALL) + REJECT_BY / 4))
        if len(langs) > 1 and len(costs):
            gaps.append(np.median(np.sort(np.delete(costs, k, 1), 1)[:, 0] - own))
    models.limits = np.array(limits)
    models.scale = 1.0 if not gaps else float(np.clip(0.1 / max(min(gaps), 1e-3), 0.02, 1.0))
    return models


def doc_cost(models: CharModels, text: str) -> tuple[np.ndarray, float]:
    """A text's costs per language and its letters, both weighted."""
    words = [(w, DIGIT_WEIGHT if DIGIT.search(token) else 1.0) for token in text.split() for w in letters(token)]
    if not words:
        return np.zeros(len(models.langs)), 0.0
    cost, size = models.word_costs([w for w, _ in words])
    weight = np.array([x for _, x in words])
    return weight @ cost, float(weight @ size)


def _tables(words: Counter) -> dict:
    """Probabilities of the n-grams seen in one language, interpolated from
    order 1 up, and the weights of their contexts."""
    names = list(words) or ["a"]
    weight = np.array([words.get(w, 1) for w in names], np.float64)
    codes, owner = _grid(names)
    at = np.flatnonzero(owner >= 0)
    w = weight[owner[at]]
    orders, prob, ctx_h, ctx_b = [], {}, [], []
    counts: dict[int, tuple] = {}
    for n in range(1, ORDER + 1):
        window = np.stack([codes[at - n + 1 + k] for k in range(n)], 1)
        h = _hash_grams(window)
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        counts[n] = (u, window[first], np.bincount(inv, w))
    for n in range(1, ORDER + 1):
        u, rows, c = counts[n]
        if n < ORDER:  # continuation counts: distinct characters to the left
            up = counts[n + 1]
            c = np.bincount(np.searchsorted(u, _hash_grams(up[1][:, 1:])), minlength=len(u)).astype(np.float64)
            c = np.maximum(c, 1)
        if n == 1:
            p = (c + 0.5) / (c.sum() + 0.5 * (len(c) + 1))
        else:
            ch, inv = np.unique(_hash_grams(rows[:, :-1]), return_inverse=True)
            total, kinds = np.bincount(inv, c), np.bincount(inv)
            lam = DISCOUNT * kinds / total
            low = prob[n - 1][np.searchsorted(counts[n - 1][0], _hash_grams(rows[:, 1:]))]
            p = np.maximum(c - DISCOUNT, 0) / total[inv] + lam[inv] * low
            ctx_h.append(ch)
            ctx_b.append(np.log10(lam))
        prob[n] = p
        orders.append((u, np.log10(p)))
    h = np.concatenate(ctx_h)
    order = np.argsort(h)
    return {"grams": orders, "contexts": (h[order], np.concatenate(ctx_b)[order]), "rows": {n: counts[n][:2] for n in counts}}


def _flatten(tables: dict, lang: str, langs: list[str], grams: np.ndarray, contexts: np.ndarray, backoff: np.ndarray, floor: float) -> np.ndarray:
    """log10 P in one language of every n-gram that any language has seen, with
    the backoff of unseen ones worked in, so that one lookup suffices."""
    out = np.zeros(len(grams), np.float32)
    own = tables[lang]["grams"]
    for n in range(1, ORDER + 1):
        merged_u = np.concatenate([tables[k]["rows"][n][0] for k in langs])
        merged_r = np.concatenate([tables[k]["rows"][n][1] for k in langs])
        u, first = np.unique(merged_u, return_index=True)
        rows = merged_r[first]
        if n == 1:
            val = np.full(len(u), floor, np.float64)
        else:
            val = out[np.searchsorted(grams, _hash_grams(rows[:, 1:]))].astype(np.float64)
            ch = _hash_grams(rows[:, :-1])
            i = np.minimum(np.searchsorted(contexts, ch), len(contexts) - 1)
            val += np.where(contexts[i] == ch, backoff[i], 0.0)
        h, p = own[n - 1]
        val[np.searchsorted(u, h)] = p
        out[np.searchsorted(grams, u)] = val
    return out


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> dict[str, list[str]]:
    """Whole texts of about ``per_language`` documents of each language, picked
    by a hash of their id; a language's rows are counted over the whole table.
    The driver gets at most about ``per_language`` texts a language, of at most
    MAX_LANGUAGES languages; more are an error."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} language labels")
    if not counts:
        return {}
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    unit = F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    out: dict[str, list[str]] = {k: [] for k in counts}
    for r in rows.where(unit < share[F.col(lang_col)]).select(lang_col, text_col).toLocalIterator():
        out[r[0]].append(r[1])
    return {k: sorted(v) for k, v in out.items() if v}


#: Costs of words that a Python worker has scored, per model; emptied at a size.
_SEEN: dict = {}
keeps_cache("langid", _SEEN.clear)
SEEN_LIMIT = 300_000


def identify(docs: DataFrame, models: CharModels, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Per row: id, lang_pred, score and rejected; with ``keep``, all columns of
    ``docs`` and these three.

    A text that is null or has no letter gets ``und``, score 0 and rejected.
    Without any learned language every row gets ``und``. Ties take the first
    language by name. Equal texts get equal results. Columns of ``docs`` named
    like a result are replaced.
    """
    spark = ready(docs.sparkSession)
    base = docs.drop("lang_pred", "score", "rejected") if keep else docs.select(id_col, text_col)
    shared = spark.sparkContext.broadcast(models)  # bounded by the training sample
    key = (len(models.grams), zlib.crc32(models.logp.tobytes()), zlib.crc32(models.grams.tobytes()))
    at = base.columns.index(text_col)
    kinds = len(models.langs)
    names_out = [*(base.columns if keep else [id_col]), "lang_pred", "score", "rejected"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache("langid")
        m = shared.value
        if key not in _SEEN:
            _SEEN.clear()
            _SEEN[key] = {}
        for batch in batches:
            seen = _SEEN[key]
            if len(seen) > SEEN_LIMIT:
                seen.clear()
            texts = [(t or "").split() for t in batch.column(at).to_pylist()]
            fresh = list({w for t in texts for w in t if w not in seen}) if kinds else []
            for lo in range(0, len(fresh), 50_000):
                part = fresh[lo : lo + 50_000]
                split = [letters(w) for w in part]
                flat = [x for s in split for x in s]
                if flat:
                    cost, size = m.word_costs(flat)
                    owner = np.repeat(np.arange(len(part)), [len(s) for s in split])
                    full = np.stack([np.bincount(owner, cost[:, k], len(part)) for k in range(kinds)] + [np.bincount(owner, size, len(part))], 1)
                    full[[i for i, w in enumerate(part) if DIGIT.search(w)]] *= DIGIT_WEIGHT
                else:
                    full = np.zeros((len(part), kinds + 1))
                seen.update(zip(part, full.astype(np.float32).view(f"V{4 * kinds + 4}").ravel().tolist()))
            sums = np.zeros((len(texts), kinds + 1))
            for i, t in enumerate(texts):
                if t and kinds:
                    sums[i] = np.frombuffer(b"".join(map(seen.__getitem__, t)), np.float32).reshape(-1, kinds + 1).sum(0, dtype=np.float64)
            size = sums[:, -1]
            if kinds:
                best, score, far = m.judge(sums[:, :-1], size)
                names = [m.langs[b] if n else "und" for b, n in zip(best, size)]
            else:
                names, score, far = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            out = [pa.array(names, pa.string()), pa.array(np.where(size > 0, score, 0.0), pa.float64()), pa.array(far | (size == 0), pa.bool_())]
            front = list(batch.columns) if keep else [batch.column(0)]
            yield pa.RecordBatch.from_arrays(front + out, names_out)

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    fields = list(base.schema.fields) if keep else [base.schema[id_col]]
    schema = StructType(fields + [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return base.mapInArrow(judge, schema)
