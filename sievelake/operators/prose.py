"""Reduction of search results, diffs, prose and mixed text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions import text as T
from sievelake.operators import relevance as V

# ---- search results -------------------------------------------------------

GREP_LINE = r"^((?:[A-Za-z]:[\\/])?[^:]*?)([:-])([0-9]+)\2(.*)$"
FILES, PER_FILE, MATCHES = 15, 5, 30


def grep_matches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, file, line_no, sep, content) of ``file:line:content`` lines,
    or with ``-``; a drive letter belongs to the file."""
    rows = docs.select(key, F.posexplode(T.lines(F.col(text))).alias("pos", "raw")).withColumn("raw", F.trim("raw")).where(F.col("raw").rlike(GREP_LINE))
    g = lambda i: F.regexp_extract("raw", GREP_LINE, i)
    return rows.select(key, "pos", g(1).alias("file"), g(3).cast("bigint").alias("line_no"), g(2).alias("sep"), g(4).alias("content"))


def grep_score(content: Column, query: str, keywords: tuple[str, ...] = ()) -> Column:
    """0.3 per query word over two letters, 0.5, 0.4 or 0.3 for an error,
    warning or important line, 0.4 per keyword; at most 1."""
    low = F.lower(content)
    out = F.lit(0.0)
    for w in dict.fromkeys(w for w in query.lower().split() if len(w) > 2):
        out = out + F.contains(low, F.lit(w)).cast("int") * 0.3
    cat = T.line_category(content, "search")
    out = out + F.when(cat == "error", 0.5).when(cat == "warning", 0.4).when(cat == "importance", 0.3).otherwise(0.0)
    for k in keywords:
        out = out + F.contains(low, F.lit(k.lower())).cast("int") * 0.4
    return F.least(F.lit(1.0), out)


def grep_select(matches: DataFrame, key: str, query: str, files: int = FILES, per_file: int = PER_FILE, most: int = MATCHES) -> DataFrame:
    """(key, file, line_no, content, score): the best files by total score, in
    each the first, the last and the best matches, equal ones once, and a cap
    over all files in their order."""
    m = matches.withColumn("score", grep_score(F.col("content"), query)).dropDuplicates([key, "file", "line_no", "content"])
    total = m.groupBy(key, "file").agg(F.round(F.sum("score"), 6).alias("total"))
    rank = total.withColumn("file_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("total"), "file"))).where(F.col("file_rank") <= files)
    w = Window.partitionBy(key, "file")
    m = m.join(rank.select(key, "file", "file_rank"), [key, "file"])
    m = m.withColumn("_a", F.row_number().over(w.orderBy("line_no", "content"))).withColumn("_z", F.row_number().over(w.orderBy(F.desc("line_no"), F.desc("content"))))
    m = m.withColumn("in_file", F.row_number().over(w.orderBy(F.when(F.col("_a") == 1, 0).when(F.col("_z") == 1, 1).otherwise(2), F.desc("score"), "line_no", "content"))).where(F.col("in_file") <= per_file)
    m = m.withColumn("_g", F.row_number().over(Window.partitionBy(key).orderBy("file_rank", "in_file"))).where(F.col("_g") <= most)
    return m.select(key, "file", "line_no", "content", "score")


def grep_render(selected: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """(key, text): the kept lines by file and line, and how many are left out."""
    n = matches.groupBy(key, "file").agg(F.count("*").alias("n"))
    line = F.struct("line_no", F.concat("file", F.lit(":"), F.col("line_no").cast("string"), F.lit(":"), "content").alias("t"))
    per = selected.groupBy(key, "file").agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["t"]).alias("ls"), F.count("*").alias("k")).join(n, [key, "file"])
    more = F.when(F.col("n") > F.col("k"), F.array(F.concat(F.lit("[... and "), (F.col("n") - F.col("k")).cast("string"), F.lit(" more matches in "), "file", F.lit("]")))).otherwise(F.expr("cast(array() as array<string>)"))
    block = F.struct("file", F.array_join(F.concat("ls", more), "\n").alias("t"))
    return per.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(block)), lambda x: x["t"]), "\n").alias("text"))


# ---- diffs ----------------------------------------------------------------

FILE_HEADER, HUNK_HEADER = r"^diff --(git|combined|cc) ", r"^@@+ .*@@+"
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Gemfile.lock", "composer.lock", "go.sum", "uv.lock", "Pipfile.lock")
PRIORITY = r"(?i)\b(error|exception|fail(ed|ure)?|fatal|critical|crash|panic|important|note|todo|fixme|hack|xxx|bug|fix|security|auth|password|secret|token)\b"


def diff_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, file_no, hunk_no, line, kind): lines with running numbers of
    file and hunk (0 before the first); kind is file, meta, hunk, add, del,
    context or other."""
    w = Window.partitionBy(key).orderBy("pos")
    rows = docs.select(key, F.posexplode(T.lines(F.col(text))).alias("pos", "line"))
    l = F.col("line")  # noqa: E741
    rows = rows.withColumn("_f", l.rlike(FILE_HEADER).cast("int")).withColumn("_h", l.rlike(HUNK_HEADER).cast("int"))
    rows = rows.withColumn("file_no", F.sum("_f").over(w)).withColumn("hunk_no", F.sum("_h").over(Window.partitionBy(key, "file_no").orderBy("pos")))
    kind = (
        F.when(F.col("_f") == 1, "file").when(F.col("_h") == 1, "hunk").when((F.col("hunk_no") == 0) | l.rlike(r"^(--- |\+\+\+ )"), "meta")
        .when(l.startswith("+"), "add").when(l.startswith("-"), "del").when(l.startswith(" ") | (l == ""), "context").otherwise("other")
    )
    return rows.select(key, "pos", "file_no", "hunk_no", "line", kind.alias("kind"))


def diff_hunks(rows: DataFrame, key: str, query: str = "") -> DataFrame:
    """(key, file_no, hunk_no, header, adds, dels, score, whitespace_only,
    lockfile): score is 0.03 a change up to 0.3, 0.2 a query word over two
    letters, 0.3 for a word of weight; at most 1."""
    inside = rows.where("hunk_no > 0")
    any_of = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    low = F.lower("line")
    body = F.col("kind") != "hunk"
    words = [w for w in dict.fromkeys(query.lower().split()) if len(w) > 2]
    g = inside.groupBy(key, "file_no", "hunk_no").agg(
        F.max(F.when(F.col("kind") == "hunk", F.col("line"))).alias("header"),
        F.sum((F.col("kind") == "add").cast("int")).alias("adds"),
        F.sum((F.col("kind") == "del").cast("int")).alias("dels"),
        any_of(body & F.col("line").rlike(PRIORITY)).alias("weight"),
        any_of(F.col("kind").isin("add", "del") & (F.trim(F.expr("substring(line, 2)")) != "")).alias("real"),
        *[any_of(body & F.contains(low, F.lit(w))).alias(f"w{i}") for i, w in enumerate(words)],
    )
    score = F.least(F.lit(0.3), (F.col("adds") + F.col("dels")) * 0.03)
    for i in range(len(words)):
        score = score + F.col(f"w{i}").cast("int") * 0.2
    score = F.least(F.lit(1.0), score + F.col("weight").cast("int") * 0.3)
    path = F.regexp_extract("line", r"(?: b/| )(\S+)$", 1)
    lock = F.regexp_extract(path, r"([^/\\]+)$", 1).isin(*LOCKFILES)
    files = rows.where("kind = 'file'").select(key, "file_no", lock.alias("lockfile"))
    return g.join(files, [key, "file_no"], "left").select(key, "file_no", "hunk_no", "header", "adds", "dels", score.alias("score"), (~F.col("real") & (F.col("adds") + F.col("dels") > 0)).alias("whitespace_only"), F.coalesce("lockfile", F.lit(False)).alias("lockfile"))


def diff_select(hunks: DataFrame, key: str, per_file: int = 10, files: int = 20) -> DataFrame:
    """(key, file_no, hunk_no): files with most changes, in each the first, the
    last and the best hunks; noise (lockfiles, blank changes) is left out."""
    h = hunks.where("not whitespace_only and not lockfile")
    size = h.groupBy(key, "file_no").agg(F.sum(F.col("adds") + F.col("dels")).alias("c"))
    top = size.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("c"), "file_no"))).where(F.col("_r") <= files).select(key, "file_no")
    w = Window.partitionBy(key, "file_no")
    h = h.join(top, [key, "file_no"], "left_semi").withColumn("_a", F.row_number().over(w.orderBy("hunk_no"))).withColumn("_z", F.row_number().over(w.orderBy(F.desc("hunk_no"))))
    h = h.withColumn("_r", F.row_number().over(w.orderBy(F.when((F.col("_a") == 1) | (F.col("_z") == 1), 0).otherwise(1), F.desc("score"), "hunk_no")))
    return h.where(F.col("_r") <= per_file).select(key, "file_no", "hunk_no")


def diff_context(rows: DataFrame, key: str, reach: int = 2) -> DataFrame:
    """Hunk lines within ``reach`` of a change, and backslash notes."""
    w = Window.partitionBy(key, "file_no", "hunk_no").orderBy("pos")
    inside = rows.where("hunk_no > 0 and kind != 'hunk'").withColumn("_c", F.col("kind").isin("add", "del").cast("int"))
    return inside.withColumn("_n", F.max("_c").over(w.rowsBetween(-reach, reach))).where((F.col("_n") == 1) | F.col("line").startswith("\\")).drop("_c", "_n")


# ---- prose ----------------------------------------------------------------

_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_HEADER = re.compile(r"\s*#{1,6}(?:[ \t]|$)")
_ITEM = re.compile(r"\s*(?:[-*+]|[0-9]{1,3}[.)])[ \t]")
_SENTENCE = re.compile(r"[.!?]+[)\"'\]]*(?=\s|$)(?!\s+[a-z])")


def segments(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a Markdown text in code points: code fences whole,
    headers, list items, and sentences of paragraphs."""
    out: list[tuple[int, int, str]] = []

    def push(a: int, b: int, kind: str) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b, kind))

    def sentences(a: int, b: int) -> None:
        at = a
        for m in _SENTENCE.finditer(text, a, b):
            push(at, m.end(), "prose")
            at = m.end()
        push(at, b, "prose")

    spans, at = [], 0
    for line in text.split("\n"):
        spans.append((at, at + len(line)))
        at += len(line) + 1
    i, para = 0, None
    while i < len(spans):
        a, b = spans[i]
        line = text[a:b]
        fence = _FENCE.match(line)
        special = "fence" if fence else "header" if _HEADER.match(line) else "item" if _ITEM.match(line) else None
        if para and (special or not line.strip()):
            sentences(*para)
            para = None
        if fence:
            mark = fence[1]
            j = i + 1
            while j < len(spans):
                s = text[slice(*spans[j])].strip()
                if len(s) >= len(mark) and set(s) == {mark[0]}:
                    break
                j += 1
            push(a, spans[min(j, len(spans) - 1)][1], "fence")
            i = j
        elif special:
            push(a, b, special)
        elif line.strip():
            para = (para[0] if para else a, b)
        i += 1
    if para:
        sentences(*para)
    return out


#: Bytes of segments, about, that are held in Python at once.
SEGMENTS = 1 << 22


def text_segments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, start, end, kind, segment, n): a grammar over one text, so one
    text is the unit of work."""
    kind = docs.schema[key].dataType.simpleString()

    def pack(of, out: list[tuple]) -> pa.RecordBatch:
        types = (of, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [key, "idx", "start", "end", "kind", "segment", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            room = SEGMENTS
            # One text at a time, and its rows leave Python when there are some.
            for k, t in zip(batch.column(0), batch.column(1)):
                k, t = k.as_py(), t.as_py() or ""
                found = segments(t)
                for i, (a, b, what) in enumerate(found):
                    out.append((k, i, a, b, what, t[a:b], len(found)))
                    room -= 200 + b - a
                    if room <= 0:
                        yield pack(batch.schema.field(0).type, out)
                        out, room = [], SEGMENTS
            if out:
                yield pack(batch.schema.field(0).type, out)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, idx bigint, start bigint, end bigint, kind string, segment string, n bigint")


def text_score(segs: DataFrame, key: str, query: str = "") -> DataFrame:
    """Adds score: 0.40 relevance + 0.20 nearness to either end + 0.35 weight of
    its words + 0.10 for a number + 0.10 for two names + 0.15 for code; at most
    1. Relevance is BM25 of constant weight within the text."""
    import math

    s = F.col("segment")
    terms = V.query_terms(query)
    d = V._counted(segs, "segment", terms).withColumn("_avg", F.avg("_len").over(Window.partitionBy(key)))
    bm = V._finish(V._sum(F.col("_tf"), F.col("_len"), F.col("_avg"), [F.lit(math.log(2.0))] * len(terms), terms), F.col("_tf"), terms) if terms else F.lit(0.0)
    place = F.when(F.col("n") > 1, F.abs(2.0 * F.col("idx") / (F.col("n") - 1) - 1.0)).otherwise(F.lit(1.0))
    score = 0.40 * bm + 0.20 * place + 0.35 * T.line_priority(T.line_category(s)) + F.when(s.rlike("[0-9]"), 0.10).otherwise(0.0) + F.when(T.capitalized_entities(s) >= 2, 0.10).otherwise(0.0) + F.when(F.col("kind") == "fence", 0.15).otherwise(0.0)
    return d.withColumn("score", F.least(F.lit(1.0), score)).drop("_tf", "_len", "_avg")


def text_mandatory(segs: DataFrame) -> Column:
    """Headers, the first two and the last two segments always stay."""
    return (F.col("kind") == "header") | (F.col("idx") < 2) | (F.col("idx") >= F.col("n") - 2)


def text_dedup(segs: DataFrame, key: str, threshold: float = 0.9) -> DataFrame:
    """(key, idx, tier): segments said before in their text: exactly, but for
    digits, or by 90% of their four-word shingles. A segment that always stays
    is never marked. Shingles meet by an equi-join within a text; no text's
    segments are all paired."""
    from sievelake.operators.dedup import hashed_shingles
    from sievelake.shared import written

    # Words are cut once (a generated column), and texts dealt out once: both windows are within a text.
    s = segs.select(key, "idx", text_mandatory(segs).alias("_must"), F.explode(F.array(T.normalized_words(F.col("segment")))).alias("_w")).where(F.size("_w") > 0)
    s = s.select(key, "idx", "_must", F.explode(F.array(F.array_join("_w", " "))).alias("_t"))
    s = s.select(key, "idx", "_must", F.md5("_t").alias("_e"), F.explode(F.array(T.mask_digits(F.col("_t")))).alias("_t"))
    s = s.select(key, "idx", "_must", "_e", F.md5("_t").alias("_m"), F.sort_array(hashed_shingles(F.split("_t", " "))).alias("_h")).repartition(key)
    s = s.withColumn("_fe", F.min("idx").over(Window.partitionBy(key, "_e"))).withColumn("_fm", F.min("idx").over(Window.partitionBy(key, "_m")))
    tier = F.when(F.col("idx") > F.col("_fe"), "exact").when(F.col("idx") > F.col("_fm"), "digits")
    s = written(s.select(key, "idx", "_must", tier.alias("tier"), "_h"))
    # Sets that reach the threshold share one of the first few shingles in any
    # fixed order, so only those are joined, and of these only such as occur
    # twice; whole sets then decide.
    fresh = s.where((F.size("_h") > 0) & F.col("tier").isNull()).select(key, "idx", "_must", "_h")
    z = F.size("_h")
    first = F.explode(F.slice("_h", F.lit(1), z - F.ceil(z * threshold).cast("int") + 1))
    g = fresh.select(key, "idx", z.alias("z"), first.alias("g"))
    g = written(g.withColumn("_c", F.count("*").over(Window.partitionBy(key, "g"))).where("_c > 1").drop("_c"))
    a, b = (g.select(key, F.col("idx").alias(f"i{x}"), F.col("z").alias(f"z{x}"), "g") for x in "ab")
    pairs = a.join(b, [key, "g"]).where(f"ia < ib and least(za, zb) >= {threshold} * greatest(za, zb)").select(key, "ia", "ib").distinct()
    met = written(fresh.join(g.select(key, "idx").distinct(), [key, "idx"], "left_semi"))
    side = lambda x: met.select(key, F.col("idx").alias(f"i{x}"), F.col("_h").alias(f"h{x}"), F.col("_must").alias(f"m{x}"))
    both = F.size(F.array_intersect("ha", "hb"))
    near = pairs.join(side("a"), [key, "ia"]).join(side("b"), [key, "ib"]).where("not mb").where(both >= threshold * (F.size("ha") + F.size("hb") - both))
    near = near.select(key, F.col("ib").alias("idx")).distinct().withColumn("tier", F.lit("shingles"))
    return s.where("tier is not null and not _must").select(key, "idx", "tier").unionByName(near)


def text_select(scored: DataFrame, dups: DataFrame, key: str, share: float = 0.35, least: int = 5) -> DataFrame:
    """(key, kept): positions kept of each text: what always stays, then by score
    what still fits 35% of the characters (a longer one is skipped, shorter ones
    may follow), at least five. Greedy, so a fold over the text's segments."""
    must = text_mandatory(scored)
    d = scored.join(dups.select(key, "idx").withColumn("_d", F.lit(True)), [key, "idx"], "left").withColumn("_must", must)
    item = F.struct(F.when(F.col("_must"), 0).otherwise(1).alias("o"), (-F.round("score", 9)).alias("s"), F.col("idx").alias("i"), F.length("segment").alias("z"), F.coalesce("_d", F.lit(False)).alias("d"))
    g = d.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items"), F.ceil(F.sum(F.length("segment")) * share).alias("budget"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.expr("cast(array() as array<bigint>)").alias("kept"))

    def step(a, x):
        take = (x["o"] == 0) | (~x["d"] & ((a["used"] + x["z"] <= F.col("budget")) | (F.size(a["kept"]) < least)))
        return F.struct(F.when(take, a["used"] + x["z"]).otherwise(a["used"]).cast("bigint").alias("used"), F.when(take, F.concat(a["kept"], F.array(x["i"]))).otherwise(a["kept"]).alias("kept"))

    return g.select(key, F.array_sort(F.aggregate("items", zero, step)["kept"]).alias("kept"))


# ---- mixed text and tags --------------------------------------------------


def is_mixed(text: Column) -> Column:
    """Two of: a code fence, a JSON line, search lines, prose; and no one array."""
    ls = T.lines(text)
    fence = text.rlike(r"(?m)^```")
    json = T.count_lines(ls, r"^\s*[\[{]") > 0
    search = T.count_lines(ls, r"^[^\s:]+:\d+:") >= 2
    prose = T.count_lines(ls, r"^[A-Z][^{}\[\]]{20,}[.!?]") > 0
    one = F.trim(text).startswith("[") & F.try_parse_json(F.trim(text)).isNotNull()
    return (fence.cast("int") + json.cast("int") + search.cast("int") + prose.cast("int") >= 2) & ~one


def sections(text: str) -> list[tuple[str, str]]:
    """(kind, text) parts of a mixed text, in order: fenced code, JSON blocks,
    runs of search lines, and prose; joined by line breaks they are the text."""
    import json

    out: list[tuple[str, list[str]]] = []
    rows, i = text.split("\n"), 0
    while i < len(rows):
        if rows[i].startswith("```"):
            j = next((k for k in range(i + 1, len(rows)) if rows[k].startswith("```")), len(rows) - 1)
            out.append(("code", rows[i : j + 1]))
            i = j + 1
            continue
        if rows[i].lstrip()[:1] in ("[", "{"):
            for j in range(i + 1, min(len(rows), i + 500) + 1):
                try:
                    json.loads("\n".join(rows[i:j]))
                except ValueError:
                    continue
                out.append(("json", rows[i:j]))
                i = j
                break
            else:
                out.append(("prose", [rows[i]]))
                i += 1
            continue
        kind = "search" if re.match(r"[^\s:]+:\d+:", rows[i]) else "prose"
        if out and out[-1][0] == kind and kind in ("search", "prose"):
            out[-1][1].append(rows[i])
        else:
            out.append((kind, [rows[i]]))
        i += 1
    return [(k, "\n".join(r)) for k, r in out]


_TAG = re.compile(r"<([a-z][a-z0-9]*(?:[-_:][a-z0-9]+)+)(?:\s[^<>]*)?>.*?</\1>|<[a-z][a-z0-9]*(?:[-_:][a-z0-9]+)+(?:\s[^<>]*)?/>", re.S)


def protect_tags(text: str) -> tuple[str, list[str]]:
    """The text with custom tags (a name with a dash, an underscore or a colon)
    and what they enclose replaced by numbered placeholders, and the blocks."""
    mark = "␟"
    while mark in text:
        mark += "␟"
    blocks: list[str] = []

    def swap(m: re.Match) -> str:
        blocks.append(m[0])
        return f"{mark}{len(blocks) - 1}{mark}"

    return _TAG.sub(swap, text), blocks


def restore_tags(text: str, blocks: list[str]) -> str:
    for i, b in enumerate(blocks):
        text = re.sub(f"␟+{i}␟+", lambda _, b=b: b, text, count=1)
    return text
