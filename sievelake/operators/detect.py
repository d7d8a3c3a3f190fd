"""Detection of what a text is, by flags of its lines.

Every detector is an expression on one row: lines are counted inside the row,
so detection adds no shuffle and runs in the scan's stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.text import bound, count_lines, head_lines, lines

# What marks lines of each type.
DIFF_HEADER = r"^(diff --git|diff --combined |diff --cc |--- a/|@@\s+-\d+,\d+\s+\+\d+,\d+\s+@@|@@@+\s+-\d+(,\d+)?\s+(-\d+(,\d+)?\s+)+\+\d+(,\d+)?\s+@@@+)"
DIFF_CHANGE = r"^[+-][^+-]"
SEARCH_LINE = r"^[^\s:]+:\d+:"
LOG_ERROR = r"(?i)\b(ERROR|FAIL|FAILED|FATAL|CRITICAL)\b"
LOG_WARN = r"(?i)\b(WARN|WARNING)\b"
LOG_OTHER = (
    r"(?i:\b(INFO|DEBUG|TRACE)\b)", r"^\s*\d{4}-\d{2}-\d{2}", r"^\s*\[\d{2}:\d{2}:\d{2}\]", r"^={3,}|^-{3,}", r"^\s*PASSED|^\s*FAILED|^\s*SKIPPED",
    r"^npm ERR!|^yarn error|^cargo error", r"Traceback \(most recent call last\)", r"^\w*(Error|Exception):", r"^\s*at\s+[\w.$]+\(",
)
CODE = {
    "python": (r"^\s*(def|class|import|from|async def)\s+\w+", r"^\s*@\w+", r'^\s*"""', r"^\s*if __name__\s*=="),
    "javascript": (r"^\s*(function|const|let|var|class|import|export)\s+", r"^\s*(async\s+function|=>\s*\{)", r"^\s*module\.exports"),
    "typescript": (r"^\s*(interface|type|enum|namespace)\s+\w+", r"^:\s*(string|number|boolean|any|void)\b"),
    "go": (r"^\s*(func|type|package|import)\s+", r"^\s*func\s+\([^)]+\)\s+\w+"),
    "rust": (r"^\s*(fn|struct|enum|impl|mod|use|pub)\s+", r"^\s*#\["),
    "java": (r"^\s*(public|private|protected)\s+(class|interface|enum)", r"^\s*@\w+", r"^\s*package\s+[\w.]+;"),
}
ENVELOPE_KEYS = ("data", "results", "items", "hits", "records", "edges", "rows", "documents")
HTML_SIGNALS = ("<body", "<div", "<p>", "<p ", "<span", "<article", "<table")


def any_of(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def any_start(patterns: tuple[str, ...]) -> str:
    """As :func:`any_of` of patterns that all begin with ``^``: written so that
    the matcher looks at the start of a line only."""
    return "^(?:" + "|".join(f"(?:{p.removeprefix('^')})" for p in patterns) + ")"


def _filled(ls: Column) -> Column:
    return F.size(F.filter(ls, lambda x: F.trim(x) != ""))


def json_confidence(text: Column) -> Column:
    """1.0 for a JSON array of objects, 0.8 for another array, else null."""
    objects = lambda items: (F.size(items) > 0) & F.forall(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    found = F.when(F.trim(text).startswith("["), F.try_variant_get(F.try_parse_json(F.trim(text)), "$", "array<variant>"))
    return bound(found, lambda items: F.when(items.isNotNull(), F.when(objects(items), 1.0).otherwise(0.8)))


def array_of_objects(v: Column, key: str) -> Column:
    records = lambda x: x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda y: F.schema_of_variant(y).startswith("OBJECT"))
    return bound(F.try_variant_get(v, f"$.{key}", "array<variant>"), records)


def envelope_key(text: Column) -> Column:
    """The one wrapper key that holds a list of objects; null if none or many."""
    parsed = F.when(F.ltrim(text).startswith("{"), F.try_parse_json(F.trim(text)))
    keys = lambda v: F.array_compact(F.array(*[F.when(array_of_objects(v, k), F.lit(k)) for k in ENVELOPE_KEYS]))
    return F.when(F.ltrim(text).startswith("{"), bound(parsed, lambda v: bound(keys(v), lambda found: F.when(F.size(found) == 1, found[0]))))


def _diff(head: Column) -> Column:
    return bound(count_lines(head, DIFF_HEADER), lambda h: F.when(h > 0, F.least(F.lit(1.0), 0.5 + h * 0.2 + count_lines(head, DIFF_CHANGE) * 0.05)))


def diff_confidence(text: Column) -> Column:
    return bound(head_lines(text, 500), _diff)


def _search(head: Column) -> Column:
    hits = F.size(F.filter(head, lambda x: (F.trim(x) != "") & x.rlike(SEARCH_LINE)))

    def of(n: Column) -> Column:
        return F.when(n > 0, bound(n / _filled(head), lambda ratio: F.when(ratio >= 0.3, F.least(F.lit(1.0), 0.4 + ratio * 0.6))))

    return bound(hits, of)


def search_confidence(text: Column) -> Column:
    return bound(head_lines(text, 100), _search)


#: As LOG_OTHER: what is looked for at the start of a line, and what anywhere.
_LOG_STARTS = any_start(tuple(p for alternatives in LOG_OTHER[1:] for p in alternatives.split("|^") if alternatives.startswith("^")))
_LOG_WORDS, _LOG_TRACE = LOG_OTHER[0], "Traceback (most recent call last)"


def _log(head: Column) -> Column:
    """Words in any case are looked for where their letters occur."""
    some = lambda low, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))

    def mark(x: Column) -> Column:
        def of(low: Column) -> Column:
            severe = some(low, ("error", "fail", "fatal", "critical", "warn")) & (x.rlike(LOG_ERROR) | x.rlike(LOG_WARN))
            other = x.rlike(_LOG_STARTS) | F.contains(x, F.lit(_LOG_TRACE)) | (some(low, ("info", "debug", "trace")) & x.rlike(_LOG_WORDS))
            return F.when(severe, 2).when(other, 1).otherwise(0)

        return bound(F.lower(x), of)

    def of(marks: Column) -> Column:
        hits, errors = F.size(F.filter(marks, lambda m: m > 0)), F.size(F.filter(marks, lambda m: m == 2))
        score = lambda ratio: F.when(ratio >= 0.1, F.least(F.lit(1.0), 0.3 + ratio * 0.5 + errors * 0.05))
        return F.when(hits > 0, bound(hits / _filled(head), score))

    return bound(F.transform(head, mark), of)


def log_confidence(text: Column) -> Column:
    return bound(head_lines(text, 200), _log)


def _code(head: Column) -> Column:
    scores = F.array(*[F.struct(count_lines(head, any_start(p)).alias("n"), F.lit(-i).alias("rank"), F.lit(lang).alias("lang")) for i, (lang, p) in enumerate(CODE.items())])

    def of(best: Column) -> Column:
        n = best["n"]
        ratio = n / F.greatest(_filled(head), F.lit(1))
        return F.when(n >= 3, F.struct(F.least(F.lit(1.0), 0.4 + ratio * 0.4 + n * 0.02).alias("confidence"), best["lang"].alias("language")))

    return bound(F.array_max(scores), of)


def code_language(text: Column) -> Column:
    """struct(confidence, language) of the language whose patterns hit most
    lines, the first of the table on ties; null below three hits."""
    return bound(head_lines(text, 100), _code)


def is_html(text: Column) -> Column:
    """A document by its first tag, or a fragment by two structural tags."""
    head = F.lower(F.substring(F.ltrim(text), 1, 256))

    def fragment(low: Column) -> Column:
        signals = F.lit(0)
        for s in HTML_SIGNALS:
            signals = signals + low.contains(s).cast("int")
        return low.contains("</") & (signals >= 2)

    return head.startswith("<!doctype html") | head.startswith("<html") | bound(F.lower(text), fragment)


def csv_delimiter(text: Column, least_bytes: int = 200, least_rows: int = 5) -> Column:
    """The delimiter of a rectangular table among comma, tab and semicolon, or
    null: at least 200 characters and five data rows, and 90% of the first 200
    lines with the header's number of fields; a tie is no answer. Quoting is
    not interpreted here."""
    body = F.trim(text)
    fields = lambda x, d: F.size(F.split(x, d))
    rank = lambda s: F.struct(s["ratio"].alias("r"), s["n"].alias("n"))

    def score(h: Column, d: str) -> Column:
        def of(n: Column) -> Column:
            ratio = F.size(F.filter(h, lambda x: fields(x, d) == n)) / F.size(h)
            return F.when(n >= 2, bound(ratio, lambda r: F.when(r >= 0.9, F.struct(r.alias("ratio"), n.alias("n"), F.lit(d).alias("d")))))

        return bound(fields(F.try_element_at(h, F.lit(1)), d), of)

    def of(ls: Column) -> Column:
        found = bound(F.slice(ls, 1, 200), lambda h: F.array_compact(F.array(*[score(h, d) for d in (",", "\t", ";")])))
        top = bound(found, lambda f: bound(F.array_max(F.transform(f, rank)), lambda best: F.filter(f, lambda s: rank(s) == best)))
        return F.when(F.size(ls) >= least_rows + 1, bound(top, lambda t: F.when(F.size(t) == 1, t[0]["d"])))

    ok = (F.length(text) >= least_bytes) & ~body.rlike(r"^[\[{<]")
    return F.when(ok, bound(F.filter(lines(body), lambda x: F.trim(x) != ""), of))


def content_type(text: Column) -> Column:
    """struct(content_type, confidence): json_array, diff, search, build,
    source_code or text, in this order of precedence."""
    pair = lambda t, c: F.struct(F.lit(t).alias("content_type"), F.round(c, 6).alias("confidence"))
    first = lambda head, n: F.slice(head, 1, n)

    # Each confidence is computed once, and only if none before it decided.
    def by_lines(head: Column) -> Column:
        code = bound(_code(first(head, 100))["confidence"], lambda c: F.when(c >= 0.5, pair("source_code", c)).otherwise(pair("text", F.lit(0.5))))
        log = bound(_log(first(head, 200)), lambda c: F.when(c >= 0.5, pair("build", c)).otherwise(code))
        csv = F.when(csv_delimiter(text).isNotNull(), pair("json_array", F.lit(0.9))).otherwise(log)
        search = bound(_search(first(head, 100)), lambda c: F.when(c >= 0.6, pair("search", c)).otherwise(csv))
        return bound(_diff(head), lambda c: F.when(c >= 0.7, pair("diff", c)).otherwise(search))

    def of(json: Column) -> Column:
        return (
            F.when(json.isNotNull(), pair("json_array", json))
            .when(envelope_key(text).isNotNull(), pair("json_array", F.lit(0.9)))
            .otherwise(bound(head_lines(text, 500), by_lines))
        )

    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", pair("text", F.lit(0.0))).otherwise(bound(json_confidence(text), of))


#: Content type to the reducer that handles it. Fixed values.
STRATEGY = {"json_array": "smart_crusher", "source_code": "code_aware", "search": "search", "build": "log", "diff": "diff", "text": "text"}


def strategy_of(content_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STRATEGY.items() for x in kv])
    return F.coalesce(table[content_type], F.lit("text"))


def min_ratio(pressure: Column, relaxed: float = 0.85, aggressive: float = 0.95) -> Column:
    """The compression ratio that is still accepted, rising with context use."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), pressure))
    return F.lit(relaxed) + (aggressive - relaxed) * p


def array_kind(items: Column) -> Column:
    """Kind of an array of variants: empty, dict, string, number, bool, nested
    or mixed. Nulls make it mixed."""
    kind = lambda x: (
        F.when(F.schema_of_variant(x).startswith("OBJECT"), "dict_array")
        .when(F.schema_of_variant(x).startswith("ARRAY"), "nested_array")
        .when(F.schema_of_variant(x) == "STRING", "string_array")
        .when(F.schema_of_variant(x) == "BOOLEAN", "bool_array")
        .when(F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), "number_array")
        .otherwise("mixed_array")
    )
    kinds = F.array_distinct(F.transform(items, kind))
    return F.when(F.size(items) == 0, "empty").when(F.size(kinds) == 1, kinds[0]).otherwise("mixed_array")


def cell_class(value: Column) -> Column:
    """scalar, json, base64, html or long: what a string cell holds."""
    body = F.regexp_replace(value, "=+$", "")
    b64 = (F.length(value) >= 64) & (F.length(F.regexp_replace(value, "[^A-Za-z0-9+/=]", "")) >= 0.95 * F.length(value)) & (F.size(F.array_distinct(F.split(body, ""))) >= 16)
    tags = F.regexp_count(value, F.lit("<[A-Za-z]")) >= 3
    json = F.trim(value).rlike(r"^[\[{]") & F.try_parse_json(value).isNotNull()
    return F.when(json, "json").when(b64, "base64").when(tags, "html").when(F.octet_length(value) > 256, "long").otherwise("scalar")


def glob_pattern(glob: str) -> str:
    """A case-insensitive regular expression for an exact name or a glob."""
    out = "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c == "_" else "\\" + c for c in glob)
    return f"(?i)^{out}$"


def tool_excluded(tool: Column, globs: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | tool.rlike(glob_pattern(g))
    return out


# Words by which a user asks to look at code itself.
ANALYSIS_WORDS = ("analyze", "analyse", "review", "explain", "debug", "audit", "inspect", "refactor", "understand", "walk through")


def analysis_intent(text: Column) -> Column:
    return F.lower(text).rlike(r"\b(" + "|".join(ANALYSIS_WORDS) + r")\b")


def message_disposition(messages: DataFrame, conv: str, turn: str, role: str, text: str, least_chars: int = 200, protect_recent: int = 2, excluded: tuple[str, ...] = ("read*",)) -> DataFrame:
    """Adds ``disposition`` to messages: the first gate that holds of frozen,
    excluded_tool, protected_role, small, error_protected, already_compressed,
    recent, analysis, compressible. ``frozen`` holds up to the last message of
    the conversation that carries a cache marker."""
    from pyspark.sql import Window

    whole = Window.partitionBy(conv)
    after = Window.partitionBy(conv).orderBy(F.desc(turn))
    t = F.col(text)
    marked = messages.withColumn("_mark", F.max(F.when(t.contains("[cache]"), F.col(turn))).over(whole)).withColumn("_left", F.row_number().over(after) - 1)
    marked = marked.withColumn("_ask", F.max_by(analysis_intent(t), F.when(F.col(role) == "user", F.col(turn))).over(whole))
    from sievelake.functions.text import error_indicator_count

    gate = (
        F.when(F.col(turn) <= F.col("_mark"), "frozen")
        .when(tool_excluded(F.col(role), excluded), "excluded_tool")
        .when(F.col(role).isin("user", "system"), "protected_role")
        .when(F.length(t) < least_chars, "small")
        .when(error_indicator_count(t) >= 2, "error_protected")
        .when(t.rlike(r"hash=[0-9a-f]{12,24}"), "already_compressed")
        .when(F.col("_left") < protect_recent, "recent")
        .when(F.coalesce("_ask", F.lit(False)), "analysis")
        .otherwise("compressible")
    )
    return marked.withColumn("disposition", gate).drop("_mark", "_left", "_ask")
