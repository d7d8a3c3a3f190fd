"""Which rows of a collection to keep: reason-tagged sets of (coll, ord).

Each signal is a DataFrame of positions with a reason; a plan is their union.
Everything is keyed by collection, so plans run on all collections at once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.text import tokens
from sievelake.operators import profile as P
from sievelake.operators import relevance as V

KEY = ("coll", "ord")


def positions(cells: DataFrame) -> DataFrame:
    """(coll, ord, pos, n): positions 0.. in a collection and its size."""
    rows = cells.select(*KEY).distinct()
    w = Window.partitionBy("coll")
    return rows.withColumn("pos", F.row_number().over(w.orderBy("ord")) - 1).withColumn("n", F.count("*").over(w))


def row_text(cells: DataFrame) -> DataFrame:
    """(coll, ord, text): a row's cells, by name, as ``name=value`` lines."""
    item = F.struct("field", F.concat("field", F.lit("="), F.coalesce("s", F.lit("null"))).alias("t"))
    return cells.groupBy(*KEY).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), "\n").alias("text"))


def content_hashes(cells: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(coll, ord, h): a hash of a row without the columns that identify it."""
    kept = cells.where(~F.col("field").isin(*exclude)) if exclude else cells
    return row_text(kept).select(*KEY, F.substring(F.md5("text"), 1, 16).alias("h"))


def dedup_content(hashes: DataFrame) -> DataFrame:
    """The first row of each content."""
    return hashes.groupBy("coll", "h").agg(F.min("ord").alias("ord")).select(*KEY)


def families(hashes: DataFrame) -> DataFrame:
    """(coll, ord, h, size, novelty): how many rows share a content, and the
    row's rank with the rarest content first, then by position."""
    w = Window.partitionBy("coll")
    sized = hashes.withColumn("size", F.count("*").over(Window.partitionBy("coll", "h")))
    return sized.withColumn("novelty", F.row_number().over(w.orderBy("size", "ord")))


def dup_counts(cells: DataFrame, identity: tuple[str, ...]) -> DataFrame:
    """(coll, ord, field, shown, dup_count) of each content's first row: how many
    rows share it, and its identity columns with ``<varies>`` where they differ."""
    h = content_hashes(cells, identity)
    fam = h.groupBy("coll", "h").agg(F.min("ord").alias("ord"), F.count("*").alias("dup_count")).where("dup_count > 1")
    ids = cells.where(F.col("field").isin(*identity)).join(h, list(KEY))
    spread = ids.groupBy("coll", "h", "field").agg(F.count_distinct("s").alias("kinds"), F.min("s").alias("v"))
    return fam.join(spread, ["coll", "h"]).select(*KEY, "field", F.when(F.col("kinds") > 1, "<varies>").otherwise(F.col("v")).alias("shown"), "dup_count")


def singletons(cells: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a value that occurs once in some column that is no identity."""
    kept = cells.where(F.col("s").isNotNull())
    kept = kept.where(~F.col("field").isin(*exclude)) if exclude else kept
    once = kept.groupBy("coll", "field", "s").agg(F.count("*").alias("n"), F.min("ord").alias("ord")).where("n = 1")
    return once.select(*KEY).distinct()


def minority(flagged: DataFrame, cells: DataFrame) -> DataFrame:
    """The flagged rows of collections in which at most half of the rows are."""
    sizes = cells.groupBy("coll").agg(F.count_distinct("ord").alias("n"))
    few = flagged.groupBy("coll").agg(F.count_distinct("ord").alias("k")).join(sizes, "coll").where("2 * k <= n").select("coll")
    return flagged.join(few, "coll", "left_semi")


def density(cells: DataFrame) -> DataFrame:
    """(coll, ord, density): 0.4 value rarity + 0.3 length + 0.3 structural
    rarity, each in [0, 1]; neutral 0.5 in collections of one row."""
    n = cells.groupBy("coll").agg(F.count_distinct("ord").alias("n"))
    vals = cells.where("s is not null").withColumn("same", F.count("*").over(Window.partitionBy("coll", "field", "s"))).join(n, "coll")
    rare = vals.groupBy(*KEY).agg(F.avg(1.0 - F.col("same") / F.col("n")).alias("rare"))
    text = row_text(cells).withColumn("len", F.length("text"))
    w = Window.partitionBy("coll")
    text = text.withColumn("lo", F.min("len").over(w)).withColumn("hi", F.max("len").over(w))
    have = cells.where("s is not null").groupBy("coll", "field").agg(F.count("*").alias("k")).join(n, "coll")
    marks = have.withColumn("common", F.col("k") >= 0.8 * F.col("n")).withColumn("odd", F.col("k") < 0.2 * F.col("n"))
    kinds = marks.groupBy("coll").agg(F.sum(F.col("common").cast("int")).alias("nc"), F.sum(F.col("odd").cast("int")).alias("no"))
    row = cells.where("s is not null").join(marks.select("coll", "field", "common", "odd"), ["coll", "field"]).groupBy(*KEY).agg(F.sum(F.col("common").cast("int")).alias("c"), F.sum(F.col("odd").cast("int")).alias("o"))
    j = text.join(rare, list(KEY), "left").join(row, list(KEY), "left").join(kinds, "coll", "left").join(n, "coll")
    part = lambda a, b: F.when(b > 0, 0.5 * a / b).otherwise(0.0)
    structural = F.least(F.lit(1.0), part(F.coalesce("o", F.lit(0)), F.coalesce("no", F.lit(0))) + part(F.coalesce("nc", F.lit(0)) - F.coalesce("c", F.lit(0)), F.coalesce("nc", F.lit(0))))
    length = F.when(F.col("hi") > F.col("lo"), (F.col("len") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    score = 0.4 * F.coalesce("rare", F.lit(0.5)) + 0.3 * length + 0.3 * structural
    return j.select(*KEY, F.when(F.col("n") < 2, 0.5).otherwise(score).alias("density"))


#: Shares of front, middle and back anchors by pattern. Fixed values.
ANCHOR_WEIGHTS = {"search_results": (0.75, 0.10, 0.15), "logs": (0.15, 0.10, 0.75), "time_series": (0.45, 0.10, 0.45), "generic": (0.5, 0.1, 0.4)}
RECENT_WORDS = ("latest", "recent", "last", "newest", "current", "now")
OLD_WORDS = ("first", "oldest", "earliest", "original", "initial", "beginning")


def anchor_weights(pattern: str, query: str = "") -> tuple[float, float, float]:
    """Weights moved by 0.15 towards the end a query asks for, then normalised."""
    front, middle, back = ANCHOR_WEIGHTS[pattern]
    q = query.lower()
    recent, old = any(w in q for w in RECENT_WORDS), any(w in q for w in OLD_WORDS)
    if recent and not old:
        front, back = max(0.1, front - 0.15), min(0.8, back + 0.15)
    elif old and not recent:
        front, back = min(0.8, front + 0.15), max(0.1, back - 0.15)
    total = front + middle + back
    return front / total, middle / total, back / total


def anchors(cells: DataFrame, budget: int, pattern: str = "generic", query: str = "") -> DataFrame:
    """(coll, ord, region): evenly spaced positions at the front, in the middle
    and at the back; a quarter of the budget, 3 to 12. Collections within the
    budget keep all rows."""
    slots = min(12, max(3, int(budget * 0.25)))
    wf, _, wb = anchor_weights(pattern, query)
    front, back = max(1, int(slots * wf)), max(1, int(slots * wb))
    middle = max(0, slots - front - back)
    pos = positions(cells)
    n = F.col("n")

    def region(name: str, lo: Column, hi: Column, k: int) -> Column:
        size = hi - lo
        spread = F.transform(F.sequence(F.lit(1), F.lit(max(k, 1))), lambda i: F.least(lo + F.floor(i * (size / F.lit(float(k + 1)))).cast("int"), hi - 1))
        every = F.sequence(lo, F.greatest(hi - 1, lo))
        picked = F.when(size <= 0, F.expr("cast(array() as array<int>)")).when(F.lit(k) >= size, every).otherwise(spread)
        return F.transform(picked, lambda p: F.struct(p.cast("int").alias("pos"), F.lit(name).alias("region")))

    fe = F.least(F.lit(2 * front), F.floor(n / 3)).cast("int")
    bs = F.greatest(n - 2 * back, F.floor(2 * n / 3)).cast("int")
    whole = F.lit(0).cast("int"), n.cast("int")
    parts = [region("front", whole[0], fe, front), region("back", bs, whole[1], back)]
    if middle:
        parts.append(region("middle", F.lit(front).cast("int"), (n - back).cast("int"), middle))
    sizes = pos.select("coll", "n").distinct()
    wanted = sizes.where(n > budget).select("coll", F.explode(F.concat(*parts)).alias("p")).select("coll", F.col("p.pos").alias("pos"), F.col("p.region").alias("region"))
    wanted = wanted.groupBy("coll", "pos").agg(F.min("region").alias("region"))
    small = pos.where(n <= budget).select(*KEY, F.lit("all").alias("region"))
    return pos.where(n > budget).join(wanted, ["coll", "pos"]).select(*KEY, "region").unionByName(small)


def cluster(cells: DataFrame, field: str, keep: int = 2, head: int = 50) -> DataFrame:
    """(coll, ord, cluster): the first two rows of each group of rows whose
    message begins alike."""
    h = F.substring(F.md5(F.substring(F.coalesce("s", F.lit("")), 1, head)), 1, 8)
    c = cells.where(F.col("field") == field).select(*KEY, h.alias("cluster"))
    w = Window.partitionBy("coll", "cluster").orderBy("ord")
    return c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep).select(*KEY, "cluster")


def top_n(cells: DataFrame, field: str, budget: int) -> DataFrame:
    """(coll, ord, rank): the budget less three rows with the highest scores;
    ties go to the earlier row, rows without a number count 0."""
    w = Window.partitionBy("coll").orderBy(F.desc(F.coalesce("x", F.lit(0.0))), "ord")
    return cells.where(F.col("field") == field).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(0, budget - 3)).select(*KEY, "rank")


def around_changes(cells: DataFrame, reach: int, sigmas: float = P.SIGMAS) -> DataFrame:
    """Rows within ``reach`` of a column's change points."""
    pos = positions(cells).select(*KEY, "pos")
    points = P.change_points(cells, sigmas=sigmas)
    near = points.select("coll", F.explode(F.expr(f"sequence(pos - {reach}, pos + {reach})")).alias("pos")).distinct()
    return pos.join(near, ["coll", "pos"]).select(*KEY)


# What a query names directly.
ANCHOR_PATTERNS = (
    r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    r"\b[0-9]{4,}\b",
    r"\b[a-zA-Z0-9][-a-zA-Z0-9]*\.[a-zA-Z0-9][-a-zA-Z0-9]*(?:\.[a-zA-Z]{2,})?\b",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
)
QUOTED = r"['\"]([^'\"]{1,50})['\"]"
NOT_HOSTS = ("e.g", "i.e", "etc.")


def query_anchors(query: str) -> list[str]:
    """UUIDs, numbers of four digits or more, host names, mail addresses and
    short quotations of a query, in lower case."""
    found = {m.lower() for p in ANCHOR_PATTERNS for m in re.findall(p, query)} - set(NOT_HOSTS)
    return sorted(found | {m.lower() for m in re.findall(QUOTED, query) if len(m.strip()) >= 2})


def anchor_matches(cells: DataFrame, query: str) -> DataFrame:
    """Rows that hold an anchor of the query; its anchors are few literals."""
    words = query_anchors(query)
    hit = F.lit(False)
    for a in words:
        hit = hit | F.contains(F.lower("text"), F.lit(a))
    return row_text(cells).where(hit).select(*KEY)


def query_relevance(cells: DataFrame, query: str, least: float = 0.3, pin: float = 0.6, most: int = 3) -> DataFrame:
    """(coll, ord, score, pinned): rows whose relevance, boosted for any match,
    reaches ``least``; the first three from ``pin`` up are pinned."""
    terms = V.query_terms(query)
    d = V._counted(row_text(cells), "text", terms).withColumn("_avg", F.avg("_len").over(Window.partitionBy("coll")))
    import math

    raw = V._sum(F.col("_tf"), F.col("_len"), F.col("_avg"), [F.lit(math.log(2.0))] * len(terms), terms)
    score = V.hybrid(V._finish(raw, F.col("_tf"), terms), F.size(F.filter("_tf", lambda x: x > 0)))
    w = Window.partitionBy("coll").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    s = d.withColumn("score", score).where(F.col("score") >= least)
    s = s.withColumn("hi", F.sum((F.col("score") >= pin).cast("int")).over(w))
    return s.select(*KEY, "score", ((F.col("score") >= pin) & (F.col("hi") <= most)).alias("pinned"))


def preserve_fields(cells: DataFrame, hashes: tuple[str, ...], query: str) -> DataFrame:
    """Rows whose value in a column named by hash (SHA-256, 8 hex digits)
    contains the query or lies in it."""
    v = F.lower("s")
    named = cells.where(F.substring(F.sha2("field", 256), 1, 8).isin(*hashes) & F.col("s").isNotNull())
    return named.where(F.contains(v, F.lit(query.lower())) | F.contains(F.lit(query.lower()), v)).select(*KEY).distinct()


def stride_fill(keep: DataFrame, hashes: DataFrame, budget: int) -> DataFrame:
    """The rows kept, filled up to the budget with rows of new content taken in
    strides over the rest: of each new content the first in visiting order."""
    w = Window.partitionBy("coll")
    all_rows = hashes.join(keep.select(*KEY).distinct().withColumn("kept", F.lit(True)), list(KEY), "left").fillna(False, ["kept"])
    all_rows = all_rows.withColumn("k", F.sum(F.col("kept").cast("int")).over(w)).withColumn("known", F.max("kept").over(Window.partitionBy("coll", "h")))
    rest = all_rows.where("not kept").withColumn("idx", F.row_number().over(w.orderBy("ord")) - 1).withColumn("m", F.count("*").over(w)).withColumn("room", F.greatest(F.lit(budget) - F.col("k"), F.lit(0)))
    rest = rest.withColumn("step", F.greatest(F.floor(F.col("m") / (F.col("room") + 1)), F.lit(1)))
    visit = F.struct((F.col("idx") % F.col("step")).alias("o"), F.col("idx").alias("i"))
    first = rest.where("not known").withColumn("visit", visit).withColumn("dup", F.row_number().over(Window.partitionBy("coll", "h").orderBy("visit"))).where("dup = 1")
    added = first.withColumn("r", F.row_number().over(w.orderBy("visit"))).where("r <= room").select(*KEY)
    return keep.select(*KEY).distinct().unionByName(added)


def reasons(cells: DataFrame, budget: int, query: str = "", pattern: str = "generic") -> DataFrame:
    """(coll, ord, reasons): the smart sample before it is cut to the budget: the
    union of anchors, error words, outliers, anomalies, rows about change points
    and what the query asks for."""
    tag = lambda d, r: d.select(*KEY, F.lit(r).alias("reason"))
    parts = [
        tag(anchors(cells, budget, pattern, query), "anchor"),
        tag(P.error_rows(cells), "error"),
        tag(P.structural_outliers(cells), "outlier"),
        tag(P.anomalies(cells), "anomaly"),
        tag(around_changes(cells, 1), "change"),
    ]
    if query:
        parts += [tag(anchor_matches(cells, query), "query"), tag(query_relevance(cells, query), "relevant")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*KEY).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def prioritize(cells: DataFrame, tagged: DataFrame, budget: int, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(coll, ord, tier): the reasons cut to a budget, one row of each content.
    Tier 0 always stays: errors, the query's rows, and outliers and anomalies
    where they are a minority, so a collection may exceed its budget; then
    singletons while a minority, the first three and last two rows, and the rest
    by novelty."""
    h = content_hashes(cells, exclude)
    pos = positions(cells)
    one = dedup_content(h.join(tagged.select(*KEY), list(KEY), "left_semi"))
    few = minority(tagged.where("arrays_overlap(reasons, array('outlier', 'anomaly'))").select(*KEY), cells).withColumn("few", F.lit(True))
    single = minority(singletons(cells, exclude), cells).withColumn("single", F.lit(True))
    filled = stride_fill(one, h, budget)
    j = (
        pos.join(families(h).select(*KEY, "novelty"), list(KEY))
        .join(tagged, list(KEY), "left").join(few, list(KEY), "left").join(single, list(KEY), "left")
        .join(filled.withColumn("cand", F.lit(True)), list(KEY), "left")
    )
    must = F.coalesce(F.expr("arrays_overlap(reasons, array('error', 'query'))"), F.lit(False)) | F.coalesce("few", F.lit(False))
    tier = F.when(must, 0).when(F.coalesce("single", F.lit(False)), 1).when((F.col("pos") < 3) | (F.col("pos") >= F.col("n") - 2), 2).when(F.coalesce("cand", F.lit(False)), 3)
    ranked = j.withColumn("tier", tier).where("tier is not null")
    w = Window.partitionBy("coll").orderBy("tier", F.when(F.col("tier") == 3, F.col("novelty")).otherwise(0), "ord")
    return ranked.withColumn("r", F.row_number().over(w)).where((F.col("r") <= budget) | (F.col("tier") == 0)).select(*KEY, "tier")


def bigram_curve(items: DataFrame, coll: str, ord: str, text: str) -> DataFrame:
    """(coll, ord, seen): distinct word pairs up to each row. A single word
    pairs with nothing, an empty text is a pair of nothings."""
    words = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")
    pairs = F.when(F.size(words) == 0, F.array(F.lit(" "))).when(F.size(words) == 1, F.array(F.concat(words[0], F.lit(" ")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: F.concat(words[i], F.lit(" "), words[i + 1]))
    )
    each = items.select(F.col(coll).alias("coll"), F.col(ord).alias("ord"), F.explode(F.array_distinct(pairs)).alias("pair"))
    new = each.groupBy("coll", "pair").agg(F.min("ord").alias("ord")).groupBy("coll", "ord").agg(F.count("*").alias("new"))
    rows = items.select(F.col(coll).alias("coll"), F.col(ord).alias("ord")).join(new, list(KEY), "left")
    return rows.select(*KEY, F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy("coll").orderBy("ord")).alias("seen"))


def knee(curve: DataFrame, value: str = "seen") -> DataFrame:
    """(coll, knee): where a rising curve bends most: the 1-based position of
    the greatest distance above its chord, null below 0.05 or three points,
    1 for a flat curve."""
    w = Window.partitionBy("coll")
    c = curve.withColumn("i", F.row_number().over(w.orderBy("ord")) - 1).withColumn("n", F.count("*").over(w)).withColumn("lo", F.first(value).over(w.orderBy("ord"))).withColumn("hi", F.last(value).over(w.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    diff = F.round((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) - F.col("i") / (F.col("n") - 1), 9)
    g = c.where("n >= 3").withColumn("d", F.when(F.col("hi") > F.col("lo"), diff))
    best = g.groupBy("coll").agg(F.max("d").alias("d"), F.max_by("i", F.struct(F.col("d"), -F.col("i"))).alias("i"))
    return best.select("coll", F.when(F.col("d").isNull(), 1).when(F.col("d") >= 0.05, F.col("i") + 1).cast("bigint").alias("knee"))


def keep_budget(k: Column) -> Column:
    """Half the adaptive size, at least 5, at most all of it."""
    return F.least(k, F.greatest(F.lit(5), F.floor(k / 2)))


def k_split(k: Column, first: float = 0.3, last: float = 0.15) -> Column:
    """struct(first, last, rest): shares rounded half to even, each at least 1,
    together never more than k."""
    a = F.least(F.greatest(F.lit(1), F.bround(k * F.lit(first))), k)
    b = F.least(F.greatest(F.lit(1), F.bround(k * F.lit(last))), k - a)
    return F.struct(a.cast("bigint").alias("first"), b.cast("bigint").alias("last"), (k - a - b).cast("bigint").alias("rest"))


def offload_gate(text: Column, ratio: Column, least_chars: int = 4000, least_ratio: float = 0.9) -> Column:
    """Whether a text that other ways hardly reduce is stored whole instead."""
    return (F.length(text) >= least_chars) & (ratio >= least_ratio) & ~text.rlike(r"hash=[0-9a-f]{12,24}")


def offload_preview(text: Column, head: int = 12, tail: int = 4) -> Column:
    """Head and tail lines of a text with severity lines of the middle between."""
    ls = F.split(text, "\n")
    n = F.size(ls)
    mid = F.when(n > head + tail, F.slice(ls, head + 1, n - head - tail)).otherwise(F.expr("cast(array() as array<string>)"))
    bad = F.slice(F.transform(F.filter(mid, lambda x: x.rlike(r"(?i)\b(error|fatal|critical|panic|exception|traceback|failed)\b")), lambda x: F.substring(x, 1, 240)), 1, 15)
    end = F.when(n > head + tail, F.slice(ls, -tail, tail)).otherwise(F.slice(ls, head + 1, F.greatest(n - head, F.lit(1))))
    return F.struct(F.slice(ls, 1, head).alias("head"), bad.alias("errors"), F.when(n > head, end).otherwise(F.expr("cast(array() as array<string>)")).alias("tail"), n.alias("n_lines"))


def min_tokens_route(lossy: Column, lossless: Column) -> Column:
    """The shorter of two equivalent views; a tie shows every row."""
    return F.when(lossless.isNull(), "lossy").when(lossy < lossless, "lossy").otherwise("lossless")
