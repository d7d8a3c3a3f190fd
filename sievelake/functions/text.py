"""Column functions on texts, lines and tokens. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word, a number of four digits or more, or a UUID: the search token. Fixed.
TOKEN = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\b[0-9]{4,}\b|[a-zA-Z0-9_]+"

# The word lists that mark lines.
ERROR_WORDS = ("error", "exception", "fail", "failed", "failure", "fatal", "critical", "crash", "panic", "abort", "timeout", "denied", "rejected")
WARNING_WORDS = ("warn", "warning")
IMPORTANCE_WORDS = ("important", "note", "todo", "fixme", "hack", "xxx", "bug", "fix")
SECURITY_WORDS = ("security", "auth", "password", "secret")
MARKDOWN_PREFIXES = ("# ", "## ", "### ", "#### ", "**", "> ")
ERROR_INDICATORS = ("error", "fail", "exception", "traceback", "fatal", "panic", "crash")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once. A column that is used inside
    a lambda would be computed anew for every element."""
    return F.transform(F.array(value), use)[0]


def word_pattern(words: tuple[str, ...]) -> str:
    """Whole words, in any case. The boundaries are ASCII."""
    return r"(?i)\b(" + "|".join(words) + r")\b"


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def head_lines(text: Column, most: int) -> Column:
    """The first ``most`` lines; what follows them is not cut."""
    return F.slice(F.split(text, "\n", most + 1), 1, most)


def count_lines(ls: Column, pattern: str) -> Column:
    return F.size(F.filter(ls, lambda x: x.rlike(pattern)))


def tokens(text: Column) -> Column:
    """Search tokens in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def normalized_words(text: Column) -> Column:
    """Words in lower case with only their letters and digits; empty ones go."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+", "")  # once per text, not per word
    return F.filter(F.split(kept, r"\s+"), lambda w: w != "")


def mask_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "#")


def capitalized_entities(text: Column) -> Column:
    """Words after the first that begin with a capital and another letter."""
    return F.regexp_count(F.regexp_replace(text, r"^\s+", ""), F.lit(r"(?<=\s)\p{Lu}\p{L}"))


def line_category(line: Column, context: str = "text") -> Column:
    """error, importance, warning, security or markdown; null for none. Errors
    and importance count in every context and the one that comes first in the
    line wins; warnings outside diffs, security in diffs, markdown in texts."""
    both = word_pattern(ERROR_WORDS + IMPORTANCE_WORDS)

    def of(hit: Column) -> Column:
        out = F.when(hit.isin(*ERROR_WORDS), "error").when(hit != "", "importance")
        out = out.when(line.rlike(word_pattern(SECURITY_WORDS)), "security") if context == "diff" else out.when(line.rlike(word_pattern(WARNING_WORDS)), "warning")
        if context == "text":
            starts = F.lit(False)
            for p in MARKDOWN_PREFIXES:
                starts = starts | line.startswith(p)
            out = out.when(starts, "markdown")
        return out

    return bound(F.lower(F.regexp_extract(line, both, 1)), of)


PRIORITY = {"error": 0.95, "security": 0.85, "warning": 0.75, "importance": 0.6, "markdown": 0.45}
CONFIDENCE = 0.7


def line_priority(category: Column) -> Column:
    def of(c: Column) -> Column:
        out = F.lit(0.0)
        for k, v in PRIORITY.items():
            out = F.when(c == k, F.lit(v)).otherwise(out)
        return out

    return bound(category, of)


def error_indicator_count(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(0)
    for w in ERROR_INDICATORS:
        out = out + low.contains(w).cast("int")
    return out


def estimate_tokens(text: Column, per: float = 4.0) -> Column:
    """Tokens by characters, at least one for a text that isn't empty."""
    n = F.length(text)
    return F.when(n > 0, F.greatest(F.lit(1), F.floor(n / F.lit(per) + 0.5))).otherwise(F.lit(0)).cast("bigint")


def auto_ratio(text: Column) -> Column:
    """Characters per token by look: 3.2 for JSON, 3.5 for code, else 4."""
    head = F.trim(F.substring(text, 1, 1000))
    json = head.startswith("{") | head.startswith("[")
    code = F.size(F.regexp_extract_all(head, F.lit(r"(?m)(\b(def|class|function|import|return|const|let|var)\b|[{};]\s*$)"), F.lit(0))) >= 5
    return F.when(json, 3.2).when(code, 3.5).otherwise(4.0)


def _tenths(n: Column, unit: int) -> Column:
    """n / unit with one decimal, halves to the even tenth: as C's printf has it,
    since a half of a tenth is exact in binary here. Java rounds it up."""
    whole, rest = F.floor(n * 10 / unit), F.pmod(n * 10, F.lit(unit))
    t = whole + F.when((rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def humanize_bytes(n: Column) -> Column:
    n = n.cast("bigint")
    return (
        F.when(n < 1024, F.format_string("%dB", n))
        .when(n < 1024 * 1024, F.concat(_tenths(n, 1024), F.lit("KB")))
        .otherwise(F.concat(_tenths(n, 1024 * 1024), F.lit("MB")))
    )


def md5_24(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 24)


def sha256_24(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 24)


def split_head(value: Column) -> tuple[Column, Column]:
    """A value cut behind its last ``/``, ``:`` or ``.``: (head, rest). Without
    one the head is empty."""
    head = F.regexp_extract(value, r"(?s)^(.*[/:.])[^/:.]*$", 1)
    return head, F.substring(value, F.length(head) + 1, F.length(value))


def parse_iso(text: Column) -> Column:
    """Epoch seconds of a strict ISO time ``YYYY-MM-DD[T ]HH:MM:SS``, optionally
    with Z or an offset; else null."""
    ok = text.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[T ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](Z|[+-][0-9]{2}:?[0-9]{2})?$")
    local = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(F.substring(text, 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.when(ok, local - tz_offset_seconds(F.substring(text, 20, 8)))


def tz_offset_seconds(zone: Column) -> Column:
    """Seconds east of UTC of ``Z``, ``+HH:MM`` or ``-HHMM``; 0 for none."""
    d = F.regexp_replace(zone, "[^0-9]", "")
    secs = F.coalesce(F.expr("0"), F.lit(0)) + F.coalesce(F.substring(d, 1, 2).try_cast("int"), F.lit(0)) * 3600 + F.coalesce(F.substring(d, 3, 2).try_cast("int"), F.lit(0)) * 60
    return F.when(zone.startswith("-"), -secs).otherwise(secs)


def render_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")


def age_text(seconds: Column) -> Column:
    of = lambda s: (
        F.when(s < 60, F.format_string("%ds ago", s))
        .when(s < 3600, F.format_string("%dm ago", F.floor(s / 60)))
        .when(s < 86400, F.format_string("%dh ago", F.floor(s / 3600)))
        .otherwise(F.format_string("%dd ago", F.floor(s / 86400)))
    )
    return bound(F.floor(seconds), of)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def shannon_bits(text: Column) -> Column:
    """Entropy in bits per character."""

    def of(t: Column) -> Column:
        kinds = F.array_distinct(F.filter(F.split(t, ""), lambda c: c != ""))
        # How often a character occurs is what a text is shorter without it.
        share = lambda k: (F.length(t) - F.length(F.replace(t, k, F.lit("")))) / F.length(t).cast("double")
        return F.aggregate(F.transform(kinds, share), F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return bound(text, of)


def has_prefixed_secret(text: Column) -> Column:
    """PEM armour, access keys, forge tokens, ``sk-`` keys and JWTs."""
    # A matcher runs only over texts that hold the letters it begins with.
    pats = (
        ("AKIA", r"(^|[^A-Za-z0-9])AKIA[A-Z0-9]{16}"),
        ("gh", r"(^|[^A-Za-z0-9])gh[pousr]_[A-Za-z0-9_]{20}"),
        ("github_pat_", r"(^|[^A-Za-z0-9])github_pat_[A-Za-z0-9_]{20}"),
        ("sk-", r"(^|[^A-Za-z0-9])sk-[A-Za-z0-9_-]{20}"),
        ("eyJ", r"(^|[^A-Za-z0-9])eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8}"),
    )
    out = text.contains("-----BEGIN ")
    for start, p in pats:
        out = out | (text.contains(start) & text.rlike(p))
    return out


def has_entropy_secret(text: Column) -> Column:
    """A hex run of 32 or more with digits and letters and at least 3 bits a
    character, or a base64 run of 40 or more of mixed kinds with at least 4."""
    hexes = F.regexp_extract_all(text, F.lit("[0-9a-fA-F]{32,}"), F.lit(0))
    b64 = F.regexp_extract_all(text, F.lit("[A-Za-z0-9+/=_-]{40,}"), F.lit(0))
    good_hex = F.exists(hexes, lambda r: r.rlike("[0-9]") & r.rlike("[a-fA-F]") & (shannon_bits(r) >= 3.0))
    good_b64 = F.exists(b64, lambda r: r.rlike("[0-9]") & r.rlike("[a-z]") & r.rlike("[A-Z]") & (shannon_bits(r) >= 4.0))
    return good_hex | good_b64


def volatile_kind(token: Column) -> Column:
    """uuid, jwt, iso8601 or hex for tokens that change from run to run."""
    return (
        F.when(token.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"), "uuid")
        .when(token.rlike(r"^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$"), "jwt")
        .when(token.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?.*)?$"), "iso8601")
        .when(token.rlike(r"^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"), "hex")
    )
