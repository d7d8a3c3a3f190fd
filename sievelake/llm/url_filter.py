"""URL filters by host suffix and path prefix, in DataFrame functions only.

Each distinct (host, path) expands into every host suffix times every path
prefix whose length some rule has. An expression meets rules by an equi-join on
a short prefix of its SHA-256; the full digest then confirms, and the longest
confirmed rule wins (a block rule before an allow rule of the same text).

Rules are a table: no side is hinted. Spark sends the rules to all tasks only
while their size is under its own broadcast limit and joins by sorting beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    in lower case. Empty for null or a url without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """Path: what follows the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", short: int = 8) -> DataFrame:
    """All columns of ``pages`` plus host, path, rule and verdict.

    ``rules`` has host, path (starting with ``/``) and verdict (allow or
    block). A rule fits its host and all subdomains when the url's path starts
    with the rule's path; the longest rule text wins, then block before allow,
    so repeated rules and ties have one result. A url without a fitting rule
    gets a null rule and ``default``.

    Null or malformed urls have an empty host and path and get ``default``;
    rules with a null host or path are ignored. Columns of ``pages`` that clash
    with the four results are replaced by them. Empty tables give empty
    results. Repeated rows of ``pages`` stay.

    The lengths of rule paths are read to the driver: distinct lengths, so at
    most as many as the longest rule path has characters.
    """
    base = pages.drop(*[c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict") and c != url_col])
    known = (
        rules.where("host is not null and path is not null")
        .select(
            F.concat(F.translate("host", UPPER, LOWER), "path").alias("_sl_rule"),
            F.col("verdict").alias("_sl_verdict"),
            F.length("path").alias("_sl_len"),
        )
        .groupBy("_sl_rule", "_sl_len")
        .agg(F.max("_sl_verdict").alias("_sl_verdict"))  # 'block' sorts after 'allow'
        .withColumn("_sl_digest", F.sha2(F.col("_sl_rule"), 256))
        .withColumn("_sl_short", F.substring("_sl_digest", 1, short))
    )
    lengths = sorted(r[0] for r in known.select("_sl_len").distinct().collect())
    rows = base.withColumns({"_sl_host": url_host(F.col(url_col)), "_sl_path": url_path(F.col(url_col))})
    labels = F.split("_sl_host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*map(F.lit, lengths)) if lengths else F.expr("cast(array() as array<int>)"), lambda n: n <= F.length("_sl_path")),
        lambda n: F.substring(F.col("_sl_path"), F.lit(1), n),
    )
    each = (
        rows.where("_sl_host != ''")
        .select("_sl_host", "_sl_path")
        .distinct()
        .select("_sl_host", "_sl_path", F.explode(suffixes).alias("_sl_suffix"))
        .select("_sl_host", "_sl_path", "_sl_suffix", F.explode(prefixes).alias("_sl_prefix"))
        .select("_sl_host", "_sl_path", F.sha2(F.concat("_sl_suffix", "_sl_prefix"), 256).alias("_sl_full"))
        .withColumn("_sl_short", F.substring("_sl_full", 1, short))
    )
    best = (
        each.join(known, "_sl_short")
        .where("_sl_full = _sl_digest")
        .groupBy("_sl_host", "_sl_path")
        .agg(F.max(F.struct(F.length("_sl_rule").alias("n"), F.col("_sl_verdict").alias("verdict"), F.col("_sl_rule").alias("rule"))).alias("_sl_best"))
    )
    # Rows without a host have no rule; they go round the join, as one key of many rows.
    has_host = F.col("_sl_host") != ""
    judged = rows.where(has_host).join(best, ["_sl_host", "_sl_path"], "left")
    rest = rows.where(~has_host).withColumn("_sl_best", F.lit(None).cast(best.schema["_sl_best"].dataType))
    return judged.unionByName(rest).select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.col("_sl_host").alias("host"),
        F.col("_sl_path").alias("path"),
        F.col("_sl_best.rule").alias("rule"),
        F.coalesce("_sl_best.verdict", F.lit(default)).alias("verdict"),
    )
