"""Filtered views of stored collections and texts.

A view is described by a :class:`RetrieveSpec`, checked on the driver, and
becomes filters, projections and limits that Spark pushes into the scan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.text import lines

#: Rows of a selection without a limit of its own, context lines and pattern
#: length at most. Fixed values.
SELECT_LIMIT, CONTEXT_MOST, PATTERN_MOST = 1000, 50, 500


@dataclass(frozen=True)
class RetrieveSpec:
    equals: tuple[tuple[str, object], ...] = ()
    ranges: tuple[tuple[str, float | None, float | None], ...] = ()
    fields: tuple[str, ...] = ()
    limit: int | None = None
    line_range: tuple[int, int] | None = None
    pattern: str | None = None
    context: int = 0


def screen_pattern(pattern: str) -> str | None:
    """Why a regular expression is refused, or None: too long, an unbounded
    repeat of an unbounded repeat, a long chain of optional parts, or invalid."""
    if len(pattern) > PATTERN_MOST:
        return "too_long"
    if re.search(r"\([^()]*[+*][^()]*\)[+*{]", pattern):
        return "nested_quantifier"
    if len(re.findall(r"(?<!\\)[?*+]", pattern)) > 20:
        return "optional_chain"
    try:
        re.compile(pattern)
    except re.error:
        return "invalid"
    return None


def parse_spec(raw: dict) -> tuple[RetrieveSpec | None, str | None]:
    """A checked spec, or the reason why there is none; it never raises."""
    known = {"equals", "ranges", "fields", "limit", "line_range", "pattern", "context"}
    if extra := set(raw) - known:
        return None, f"unknown parameter {min(extra)}"
    limit = raw.get("limit")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 1):
        return None, "limit must be a positive integer"
    span = raw.get("line_range")
    if span is not None and (len(span) != 2 or span[0] < 1 or span[1] < span[0]):
        return None, "line_range must be [first, last] with 1 <= first <= last"
    context = raw.get("context", 0)
    if isinstance(context, bool) or not isinstance(context, int) or not 0 <= context <= CONTEXT_MOST:
        return None, f"context must be 0 to {CONTEXT_MOST}"
    for f, lo, hi in raw.get("ranges", ()):
        if lo is None and hi is None:
            return None, f"range of {f} has no bound"
    if (pattern := raw.get("pattern")) is not None and (why := screen_pattern(pattern)):
        return None, f"pattern refused: {why}"
    return RetrieveSpec(tuple(raw.get("equals", ())), tuple(tuple(r) for r in raw.get("ranges", ())), tuple(raw.get("fields", ())), limit, tuple(span) if span else None, pattern, context), None


def select_equals(rows: DataFrame, field: str, value: object) -> DataFrame:
    """Rows whose field equals a scalar; null matches null only. A boolean never
    equals a number: the types must agree."""
    kind = dict(rows.dtypes)[field]
    if isinstance(value, bool) != (kind == "boolean") and value is not None:
        return rows.where(F.lit(False))
    return rows.where(F.col(field).eqNullSafe(F.lit(value)))


def select_range(rows: DataFrame, field: str, lo: float | None, hi: float | None) -> DataFrame:
    """Rows whose field is a number within inclusive bounds; open where None.
    Texts that are numbers count, other values don't match."""
    c = F.col(field)
    if dict(rows.dtypes)[field] == "boolean":
        return rows.where(F.lit(False))
    if dict(rows.dtypes)[field] == "string":
        c = c.try_cast("double")
    if lo is not None:
        rows = rows.where(c >= lo)
    return rows if hi is None else rows.where(c <= hi)


def project(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The named columns in the order asked; absent ones are left out."""
    return rows.select(*[f for f in dict.fromkeys(fields) if f in rows.columns])


def absent_fields(rows: DataFrame, fields: tuple[str, ...], most: int = 50) -> str | None:
    """A note that names unknown columns and up to 50 known ones."""
    gone = [f for f in fields if f not in rows.columns]
    return f"unknown: {', '.join(gone)}; known: {', '.join(sorted(rows.columns)[:most])}" if gone else None


def apply_spec(rows: DataFrame, spec: RetrieveSpec, ord: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(view, counts): the selected rows in order up to the limit, and one row
    with matched and returned counts, so a cut is never silent."""
    out = rows
    for f, v in spec.equals:
        out = select_equals(out, f, v)
    for f, lo, hi in spec.ranges:
        out = select_range(out, f, lo, hi)
    limit = spec.limit or (SELECT_LIMIT if spec.equals or spec.ranges else None)
    n = F.count("*")
    counts = out.agg(n.alias("matched"), (F.least(n, F.lit(limit)) if limit else n).alias("returned"))
    view = out.orderBy(ord)
    view = view.limit(limit) if limit else view
    return (project(view, spec.fields) if spec.fields else view), counts


def text_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line), numbered from 1."""
    return docs.select(key, F.posexplode(lines(F.col(text))).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def line_range(docs: DataFrame, key: str, text: str, first: int, last: int) -> DataFrame:
    """Lines first..last of each text; only those are exploded."""
    cut = F.slice(lines(F.col(text)), first, last - first + 1)
    return docs.select(key, F.posexplode(cut).alias("p", "line")).select(key, (F.col("p") + first).alias("line_no"), "line")


def pattern_context(docs: DataFrame, key: str, text: str, pattern: str, context: int = 0, span: tuple[int, int] | None = None) -> DataFrame:
    """Lines that match or lie within ``context`` lines of one that does, with
    ``is_match``; within a line range if one is given."""
    if why := screen_pattern(pattern):
        raise ValueError(f"pattern refused: {why}")
    rows = text_lines(docs.where(F.col(text).rlike(pattern) | F.lit("^" in pattern or "$" in pattern)), key, text)
    if span:
        rows = rows.where(F.col("line_no").between(*span))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(-context, context)
    hit = rows.withColumn("is_match", F.col("line").rlike(pattern))
    return hit.withColumn("near", F.max("is_match").over(w)).where("near").drop("near")


def partition_lines(docs: DataFrame, key: str, text: str, include: str | None, exclude: str | None) -> DataFrame:
    """(key, run, first_line, last_line, eligible): maximal runs of lines that
    may or may not be reduced."""
    ok = F.lit(True)
    if include:
        ok = F.col("line").rlike(include)
    if exclude:
        ok = ok & ~F.col("line").rlike(exclude)
    w = Window.partitionBy(key).orderBy("line_no")
    rows = text_lines(docs, key, text).withColumn("eligible", ok)
    marked = rows.withColumn("new", F.coalesce((F.col("eligible") != F.lag("eligible").over(w)).cast("int"), F.lit(0)))
    runs = marked.withColumn("run", F.sum("new").over(w))
    return runs.groupBy(key, "run", "eligible").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def raw_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, start, end, raw): the exact source of every element of a JSON
    array, in code points; texts that are no JSON array give no rows."""
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, blank = json.JSONDecoder(), re.compile(r"[ \t\r\n]*")
        for batch in batches:
            out: list[tuple] = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, at = [], blank.match(t or "").end()
                if not t or t[at : at + 1] != "[":
                    continue
                at = blank.match(t, at + 1).end()
                try:
                    while t[at] != "]":
                        _, end = decoder.raw_decode(t, at)
                        found.append((k, len(found), at, end, t[at:end]))
                        at = blank.match(t, end).end()
                        if t[at] == ",":
                            at = blank.match(t, at + 1).end()
                        elif t[at] != "]":
                            raise ValueError
                except (ValueError, IndexError):
                    continue
                out += found
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.int64(), pa.int64(), pa.string())))], [key, "idx", "start", "end", "raw"])

    return docs.select(key, text).mapInArrow(scan, f"`{key}` {kind}, idx bigint, start bigint, end bigint, raw string")


# The shapes of markers that stand for stored content.
BRACKET_MARKER = r"\[[^\[\]]*compressed[^\[\]]*hash=([0-9a-f]{24})\]"
ANGLE_MARKER = r"<<ccr:([0-9a-f]{24}|[0-9a-f]{12})[ ,#>][^>]{0,64}>>|<<ccr:([0-9a-f]{24}|[0-9a-f]{12})>>"
ANY_MARKER = r"\[[^\[\]]*compressed[^\[\]]*hash=[0-9a-f]{24}\]|<<ccr:(?:[0-9a-f]{24}|[0-9a-f]{12})(?:[ ,#][^>]{0,64})?>>"
MARKER_HASH = r"(?:hash=|<<ccr:)([0-9a-f]{24}|[0-9a-f]{12})"


def marker_scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, marker, hash) of every marker in a text, in order."""
    found = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(ANY_MARKER), F.lit(0))).alias("idx", "marker"))
    return found.withColumn("hash", F.regexp_extract("marker", MARKER_HASH, 1))


def resolve_markers(docs: DataFrame, key: str, text: str, store: DataFrame) -> DataFrame:
    """(key, text): every marker replaced by the stored original it names; a
    marker without an entry stays. ``store`` has hash_key and original_content.
    Only texts with markers are taken apart."""
    has = F.col(text).rlike(ANY_MARKER)
    parts = F.split(F.col(text), ANY_MARKER)
    marks = F.concat(F.regexp_extract_all(F.col(text), F.lit(ANY_MARKER), F.lit(0)), F.array(F.lit("")))
    pieces = docs.where(has).select(key, F.posexplode(F.arrays_zip(parts.alias("lead"), marks.alias("mark"))).alias("pos", "p"))
    pieces = pieces.select(key, "pos", F.col("p.lead").alias("lead"), F.col("p.mark").alias("mark"), F.regexp_extract("p.mark", MARKER_HASH, 1).alias("hash_key"))
    joined = pieces.join(store.select("hash_key", "original_content").dropDuplicates(["hash_key"]), "hash_key", "left")
    whole = joined.groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat("lead", F.coalesce("original_content", "mark")).alias("t")))), lambda x: x["t"]), "").alias(text)
    )
    return docs.where(~has | has.isNull()).select(key, text).unionByName(whole)
