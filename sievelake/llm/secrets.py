"""Secret scans with multipart linking.

Three base kinds stand for themselves (assignments, access keys, long hex
runs). Further kinds are weak: a mixed-character run that could be a secret, or
an endpoint. They are reported only when complementary parts meet: the spans of
access identifiers, endpoints and candidate secrets, each widened by ``reach``
code points within its scope (a paragraph, text between blank lines), are
joined as intervals; a weak secret needs an identifier or an endpoint nearby,
and an endpoint needs a secret and an identifier.

One pass per document in Python over whole texts: spans are code points of one
text, so nothing is shuffled and memory is bounded by a document.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import ready

KINDS = ("assign", "access", "hex", "weak", "endpoint")
BASE = KINDS[:3]

# The three base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{4,}", re.I | re.A)
#: A run of any length. '=' is padding after a run only: a value may follow one.
WEAK = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
SCOPE_BREAK = re.compile(r"\n[ \t\r]*\n")
#: A document without any of these bytes (letters lowered) has no assignment.
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
HEX_BYTES = re.compile(rb"[0-9a-f]{32}")


def _mixed(run: str) -> bool:
    """Digits and both letter cases: words and numbers alone are not secrets."""
    return any(c.isdigit() for c in run) and any(c.islower() for c in run) and any(c.isupper() for c in run)


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the base kinds, by start, then kind."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    out = []
    low = raw.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if HEX_BYTES.search(raw):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def linked_spans(text: str, base: list[tuple[int, int, str]], reach: int = 160) -> list[tuple[int, int, str]]:
    """Weak spans that complementary parts within reach and scope confirm."""
    ids = [(a, b) for a, b, k in base if k == "access"]
    ends = [m.span() for m in ENDPOINT.finditer(text)] if "://" in text else []
    if not ids and not ends:
        return []
    taken = Intervals([(a, b) for a, b, _ in base] + ends)
    weak = [m.span() for m in WEAK.finditer(text) if _mixed(m[0]) and not taken.meet(*m.span())]
    strong = [(a, b) for a, b, k in base if k != "access"]
    breaks = [m.start() for m in SCOPE_BREAK.finditer(text)]
    scope = lambda at: bisect_left(breaks, at)

    def joined_with(others: list[tuple[int, int]]):
        by_scope: dict[int, list] = {}
        for span in others:
            by_scope.setdefault(scope(span[0]), []).append(span)
        sides = {k: Intervals(v) for k, v in by_scope.items()}
        none = Intervals([])
        return lambda a, b: sides.get(scope(a), none).meet(a - reach, b + reach)

    by_id, by_end = joined_with(ids), joined_with(ends)
    found = [(a, b, "weak") for a, b in weak if by_id(a, b) or by_end(a, b)]
    by_secret = joined_with(strong + [(a, b) for a, b, _ in found])
    found += [(a, b, "endpoint") for a, b in ends if by_secret(a, b) and by_id(a, b)]
    return found


class Intervals:
    """One side of an interval join: spans by start, with the furthest end so
    far, which tells at once whether any span meets another."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.furthest = list(accumulate((b for _, b in spans), max))

    def meet(self, lo: int, hi: int) -> bool:
        """Whether a span starts before ``hi`` and ends behind ``lo``."""
        i = bisect_left(self.starts, hi)
        return i > 0 and self.furthest[i - 1] > lo


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with every span replaced; spans that overlap count as one."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False, reach: int = 160) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans and, with
    ``redact``, redacted_text.

    A null text counts as empty: no spans, and the digest of the empty string;
    its redacted text stays null. Rows whose id is null or repeated are each
    scanned. Other columns are ignored. An empty table gives an empty result.
    """
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string" + ", redacted_text string" * redact

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for raw in batch.column(1).to_pylist():
                text = (raw or b"").decode("utf-8", "replace")
                base = base_spans(text, raw or b"")
                spans = sorted(base + linked_spans(text, base, reach), key=lambda s: (s[0], KINDS.index(s[2])))
                for i, k in enumerate(BASE):
                    cols[i].append(sum(s[2] == k for s in base))
                cols[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[4].append(joined(spans))
                cols[5].append(None if raw is None else redacted(text, spans) if redact else "")
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3 : 5 + redact])]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted_text"][: 6 + redact])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_sl_text")).mapInArrow(scan, schema)


def redact_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", reach: int = 160) -> DataFrame:
    """The documents with secrets replaced in their texts and ``n_chars`` set
    anew; no row goes and all columns stay. Null texts stay null."""
    ready(docs.sparkSession)
    at = docs.columns.index(text_col)
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else -1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays, out, sizes = list(batch.columns), [], []
            old = arrays[chars].to_pylist() if chars >= 0 else []
            for i, text in enumerate(arrays[at].to_pylist()):
                spans: list = []
                if text:
                    base = base_spans(text)
                    spans = base + linked_spans(text, base, reach)
                out.append(redacted(text, spans) if spans else text)
                if chars >= 0:
                    sizes.append(len(out[-1]) if spans else old[i])
            arrays[at] = pa.array(out, arrays[at].type)
            if chars >= 0:
                arrays[chars] = pa.array(sizes, arrays[chars].type)
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return docs.mapInArrow(scan, docs.schema)
