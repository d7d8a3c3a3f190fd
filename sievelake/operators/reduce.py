"""Reduction of whole JSON documents: arrays are cut to what matters.

The document is the unit of work: parsing, choosing and rendering are sequential
in it, so they run in Python on Arrow batches, one document at a time. What is
dropped is named by hash, and the original goes to the store table, so every
reduced document can be restored.
"""

from __future__ import annotations

import hashlib
import json
import math
import statistics
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievelake.operators.profile import ERROR_KEYWORDS

MAX_ITEMS, DEPTH = 15, 50


@lru_cache(maxsize=1 << 17)
def _gram(gram: str) -> bytes:
    return hashlib.blake2b(gram.encode("utf-8", "replace"), digest_size=8).digest()


def simhash(text: str) -> int:
    """64-bit SimHash of the character 4-grams of a text in lower case; every
    window votes, and distinct grams are hashed once."""
    low = text.lower()
    grams = Counter(low[i : i + 4] for i in range(max(1, len(low) - 3)))
    hashes = b"".join(map(_gram, grams))
    votes = np.fromiter(grams.values(), np.float64, len(grams))  # whole numbers, and exact
    ones = votes @ np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).astype(np.float64)
    return int.from_bytes(np.packbits(2 * ones > votes.sum()).tobytes(), "big")


def unique_groups(texts: list[str], distance: int = 3) -> int:
    """Groups by the first member within ``distance`` bits; candidates come from
    equal 16-bit blocks, of which four differ in one at least."""
    leaders: list[int] = []
    blocks: dict[tuple[int, int], list[int]] = {}
    for h in map(simhash, texts):
        keys = [(i, h >> 16 * i & 0xFFFF) for i in range(4)]
        if not any((leaders[k] ^ h).bit_count() <= distance for key in keys for k in blocks.get(key, ())):
            for key in keys:
                blocks.setdefault(key, []).append(len(leaders))
            leaders.append(h)
    return len(leaders)


def bigram_curve(texts: list[str]) -> list[int]:
    seen: set = set()
    out = []
    for t in texts:
        w = t.lower().split()
        seen.update(zip(w, w[1:]) if len(w) > 1 else [(w[0] if w else "", "")])
        out.append(len(seen))
    return out


def find_knee(curve: list[int]) -> int | None:
    if len(curve) < 3:
        return None
    if curve[0] == curve[-1]:
        return 1
    span, last = curve[-1] - curve[0], len(curve) - 1
    gain, at = max((round((y - curve[0]) / span - i / last, 9), -i) for i, y in enumerate(curve))
    return 1 - at if gain >= 0.05 else None


def zlib_check(texts: list[str], k: int, most: int, tolerance: float = 0.15) -> int:
    """k, or a fifth more if the first k compress unlike the whole."""
    whole, part = "\n".join(texts).encode(), "\n".join(texts[:k]).encode()
    if k >= len(texts) or k >= most or len(whole) < 200:
        return k
    ratio = lambda b: len(zlib.compress(b, 1)) / len(b) if b else 1.0
    return min(int(k * 1.2), most) if abs(ratio(whole) - ratio(part)) > tolerance else k


def adaptive_k(texts: list[str], bias: float = 1.0, least: int = 3, most: int | None = MAX_ITEMS) -> int:
    """How many items say what all say: all of eight or fewer; the groups if
    they are three or fewer; else the knee of new word pairs, not below what the
    diversity asks for, checked by compression."""
    n = len(texts)
    top = n if most is None else most
    if n <= 8:
        return min(n, top)
    groups = unique_groups(texts)
    if groups <= 3:
        return min(max(least, groups), top)
    varied = groups / n
    floor = max(least, int(n * (0.3 + 0.7 * varied)))
    bend = find_knee(bigram_curve(texts))
    k = floor if bend is None else max(bend, floor) if varied > 0.7 else bend
    k = zlib_check(texts, min(max(least, int(k * bias)), top), top)
    return max(least, min(k, top))


def k_split(k: int) -> tuple[int, int]:
    first = min(max(1, round(k * 0.3)), k)
    return first, min(max(1, round(k * 0.15)), k - first)


def has_error(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in ERROR_KEYWORDS)


def _far(values: list[float], sigmas: float = 2.0) -> set[int]:
    if len(values) < 2 or not (sd := statistics.stdev(values)):
        return set()
    m = statistics.fmean(values)
    return {i for i, v in enumerate(values) if abs(v - m) > sigmas * sd}


def _boundary(n: int, k: int) -> set[int]:
    first, last = k_split(k)
    return set(range(min(first, n))) | set(range(max(0, n - last), n))


def keep_strings(items: list[str]) -> list[int]:
    """Positions kept of an array of strings: errors, odd lengths, both ends,
    and new ones in strides."""
    n = len(items)
    if n <= 8:
        return list(range(n))
    k = adaptive_k(items)
    pinned = {i for i, s in enumerate(items) if has_error(s)} | _far([float(len(s)) for s in items])
    keep = pinned | _boundary(n, k)
    seen, room = {items[i] for i in keep}, k - len(keep)
    if room > 0:
        for i in range(0, n, max(1, (n - 1) // (room + 1))):
            if len(keep) >= k + len(pinned):
                break
            if items[i] not in seen:
                seen.add(items[i])
                keep.add(i)
    return sorted(keep)


def keep_numbers(items: list) -> list[int]:
    """Positions kept of an array of numbers: outliers, change points, both ends
    and strides."""
    n = len(items)
    good = [(i, float(v)) for i, v in enumerate(items) if math.isfinite(v)]
    if n <= 8 or not good:
        return list(range(n))
    k = adaptive_k([json.dumps(v) for v in items])
    values = [v for _, v in good]
    sd = statistics.stdev(values) if len(values) > 1 else 0.0
    out = {good[i][0] for i in _far(values)}
    keep = out | _boundary(n, k)
    if sd > 0 and n > 10:
        for i in range(5, n - 5):
            left = [float(v) for v in items[i - 5 : i] if math.isfinite(v)]
            right = [float(v) for v in items[i : i + 5] if math.isfinite(v)]
            if left and right and abs(statistics.fmean(right) - statistics.fmean(left)) > 2 * sd:
                keep.add(i)
    room = k - len(keep)
    if room > 0:
        for i in range(0, n, max(1, (n - 1) // (room + 1))):
            if len(keep) >= k + len(out):
                break
            keep.add(i)
    return sorted(keep)


def keep_object_keys(obj: dict) -> list[str]:
    """Keys kept of a large object: cheap ones, errors, both ends, strides."""
    names, n = list(obj), len(obj)
    texts = {k: json.dumps(v, ensure_ascii=False) for k, v in obj.items()}
    cost = {k: len(texts[k]) // 4 + len(k) // 4 + 2 for k in names}
    if n <= 8 or sum(cost.values()) < 200:
        return names
    k = adaptive_k([f"{x}: {texts[x]}" for x in names])
    if k >= n:
        return names
    errors = {x for x in names if has_error(texts[x])}
    keep = errors | {x for x in names if cost[x] <= 12} | {names[i] for i in _boundary(n, k)}
    room = k - len(keep)
    if room > 0:
        for i in range(0, n, max(1, (n - 1) // (room + 1))):
            if len(keep) >= k + len(errors & keep):
                break
            keep.add(names[i])
    return [x for x in names if x in keep]


def keep_records(items: list[dict], budget: int | None = None, query: str = "") -> list[int]:
    """Positions kept of an array of objects: one row of each content, errors,
    rare shapes and values, numbers far off, what the query names, both ends,
    then the rarest contents, up to the budget (errors may exceed it)."""
    n = len(items)
    texts = [json.dumps(x, sort_keys=True, ensure_ascii=False) for x in items]
    k = adaptive_k(texts) if budget is None else budget
    if n <= k:
        return list(range(n))
    must = {i for i, t in enumerate(texts) if has_error(t)}
    if query:
        words = [w for w in query.lower().split() if len(w) >= 4]
        must |= {i for i, t in enumerate(texts) if any(w in t.lower() for w in words)}
    counts = Counter(key for x in items for key in x)
    odd = {i for i, x in enumerate(items) if any(counts[key] < 0.2 * n for key in x)}
    for key in [c for c, m in counts.items() if m >= 0.8 * n]:
        column = [json.dumps(x.get(key)) for x in items]
        kinds = Counter(column)
        if 2 <= len(kinds) <= 50:
            top, covered = set(), 0
            for v, m in sorted(kinds.items(), key=lambda kv: (-kv[1], kv[0])):
                if covered >= math.ceil(0.8 * n):
                    break
                top.add(v)
                covered += m
            if len(top) <= 5:
                odd |= {i for i, v in enumerate(column) if v not in top}
        nums = [(i, float(x[key])) for i, x in enumerate(items) if isinstance(x.get(key), (int, float)) and not isinstance(x.get(key), bool) and math.isfinite(x[key])]
        odd |= {nums[i][0] for i in _far([v for _, v in nums])}
    keep = must | (odd if 2 * len(odd) <= n else set())
    size = Counter(texts)
    rest = [i for i in [0, 1, 2, n - 2, n - 1] if 0 <= i < n] + sorted(range(n), key=lambda i: (size[texts[i]], i))
    seen = {texts[i] for i in keep}
    for i in rest:
        if len(keep) >= k:
            break
        if texts[i] not in seen:
            seen.add(texts[i])
            keep.add(i)
    return sorted(keep)


def keep_mixed(items: list, query: str = "") -> list[int]:
    """Positions kept of an array of several kinds, chosen within each kind."""
    kind = lambda v: "bool" if isinstance(v, bool) else "num" if isinstance(v, (int, float)) else type(v).__name__
    groups: dict[str, list[int]] = {}
    for i, v in enumerate(items):
        groups.setdefault(kind(v), []).append(i)
    keep: list[int] = []
    for name, at in groups.items():
        values = [items[i] for i in at]
        pick = {"str": keep_strings, "num": keep_numbers, "dict": lambda x: keep_records(x, query=query)}.get(name)
        keep += [at[i] for i in pick(values)] if pick and len(at) >= 5 else at
    return sorted(keep)


def keep_items(items: list, query: str = "") -> list[int]:
    kinds = {("bool" if isinstance(v, bool) else type(v).__name__) for v in items}
    if kinds == {"dict"}:
        return keep_records(items, query=query)
    if kinds == {"str"}:
        return keep_strings(items)
    if kinds and kinds <= {"int", "float"}:
        return keep_numbers(items)
    return keep_mixed(items, query) if len(items) > 8 and not kinds <= {"bool", "list"} else list(range(len(items)))


def content_key(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode("utf-8", "replace")).hexdigest()[:24]


def walk(node, dropped: dict[str, str], left: int = DEPTH, query: str = ""):
    """A document with every large array cut and a marker for what went; records
    that name a word of the query stay."""
    if isinstance(node, dict):
        names = keep_object_keys(node)
        out = {k: walk(node[k], dropped, left - 1, query) if left else node[k] for k in names}
        if len(names) < len(node):
            key = content_key(node)
            dropped[key] = json.dumps(node, ensure_ascii=False)
            out["_dropped"] = f"<<ccr:{key} {len(node) - len(names)}_keys_offloaded>>"
        return out
    if isinstance(node, list):
        at = keep_items(node, query)
        out = [walk(node[i], dropped, left - 1, query) if left else node[i] for i in at]
        if len(at) < len(node):
            key = content_key(node)
            dropped[key] = json.dumps(node, ensure_ascii=False)
            out.append({"_dropped": f"<<ccr:{key} {len(node) - len(at)}_rows_offloaded>>"})
        return out
    return node


def lossless_table(items: list[dict]) -> str | None:
    """Records of equal keys as one table, if that saves 256 bytes and 30%."""
    names = list(items[0]) if items else []
    if len(items) < 2 or any(list(x) != names for x in items):
        return None
    whole = len(json.dumps(items, ensure_ascii=False))
    text = f"[{len(items)}/{len(items)}]" + json.dumps(names) + "\n" + "\n".join(json.dumps(list(x.values()), ensure_ascii=False, separators=(",", ":")) for x in items)
    return text if whole - len(text) >= 256 and len(text) <= 0.7 * whole else None


def reduce_text(text: str | None, query: str = "") -> tuple[str | None, str, dict[str, str]]:
    """(view, how, dropped): lossless if that is shorter or as short, lossy with
    the originals in ``dropped``, or the text itself."""
    try:
        node = json.loads(text)
    except (ValueError, TypeError, RecursionError):
        return text, "passthrough", {}
    dropped: dict[str, str] = {}
    lossy = json.dumps(walk(node, dropped, query=query), ensure_ascii=False)
    table = lossless_table(node) if isinstance(node, list) and all(isinstance(x, dict) for x in node) else None
    if table is not None and (not dropped or len(table) // 4 <= len(lossy) // 4):
        return table, "lossless", {}
    return (lossy, "lossy", dropped) if dropped else (text, "passthrough", {})


def reduce_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, view, how, dropped): ``dropped`` maps hashes to stored originals."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [reduce_text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([list(r[2].items()) for r in rows], pa.map_(pa.string(), pa.string()))],
                [key, "view", "how", "dropped"],
            )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, view string, how string, dropped map<string,string>")


#: Characters of texts whose results are held in Python at once, about.
HELD = 1 << 22


def per_document(docs: DataFrame, key: str, text: str, function, schema: str) -> DataFrame:
    """(key, ...): ``function(text)`` per row as a tuple of the schema's columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    out = StructType([StructField(key, docs.schema[key].dataType)] + list(StructType.fromDDL(schema).fields))
    arrow = to_arrow_schema(out)

    def pack(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[1:]))], arrow.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            at, held = 0, 0
            # One text at a time, and results leave Python when there are some.
            for t in batch.column(1):
                t = t.as_py()
                rows.append(function(t))
                held += len(t or "")
                if held > HELD:
                    yield pack(batch.column(0).slice(at, len(rows)), rows)
                    at, held, rows = at + len(rows), 0, []
            if rows:
                yield pack(batch.column(0).slice(at, len(rows)), rows)

    return docs.select(key, text).mapInArrow(run, out)
