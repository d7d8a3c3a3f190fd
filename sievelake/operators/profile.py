"""Profiles of record collections: per-column statistics, roles, patterns, and
the decision how a collection may be reduced.

All operators take the long form of :mod:`sievelake.collections` and aggregate
by (coll, field), so partial sums are combined before the shuffle and no step
gathers a collection in one place. Those that read the cells many times do best
with cells that are already partitioned by collection: then none shuffles them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.text import shannon_bits
from sievelake.shared import written

ISO_DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}"
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
HEX_RUN = r"^(0[xX])?[0-9a-fA-F]{8,}$"
#: Standard deviations from the mean beyond which a number is an anomaly and two
#: neighbouring windows' means differ.
SIGMAS = 2.0
CHANGE_WINDOW = 5


def schema_union(cells: DataFrame) -> DataFrame:
    """(coll, field) of every column that some row of the collection has."""
    return cells.select("coll", "field").distinct()


def field_stats(cells: DataFrame) -> DataFrame:
    """One row per (coll, field). A column's type is that of its first value
    that is not null. Uniqueness counts nulls as a value; numbers count while
    finite; a single number has variance 0."""
    known = F.col("kind") != "null"
    first = F.min_by(F.struct("kind", "s"), F.when(known, F.col("ord")))
    agg = cells.groupBy("coll", "field").agg(
        first.alias("f"),
        F.count("*").alias("count"),
        F.count_distinct(F.coalesce("s", F.lit("None"))).alias("u"),
        F.sum(known.cast("bigint")).alias("known"),
        F.min("x").alias("mn"),
        F.max("x").alias("mx"),
        F.avg("x").alias("mean"),
        F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("var"),
        F.avg(F.when(F.col("kind") == "string", F.length("s"))).alias("avg_length"),
    )
    some, num = F.col("known") > 0, F.col("f.kind") == "numeric"
    u = F.when(some, F.col("u")).otherwise(0)
    return agg.select(
        "coll",
        "field",
        F.when(some, F.col("f.kind")).otherwise("null").alias("field_type"),
        "count",
        u.cast("bigint").alias("unique_count"),
        (u / F.col("count")).alias("unique_ratio"),
        ((u == 1) | ~some).alias("is_constant"),
        F.when(some & (F.col("u") == 1), F.col("f.s")).alias("constant_value"),
        F.when(num, F.col("mn")).alias("min_val"),
        F.when(num, F.col("mx")).alias("max_val"),
        F.when(num, F.col("mean")).alias("mean_val"),
        F.when(num & F.col("mn").isNotNull(), F.col("var")).alias("variance"),
        F.when(F.col("f.kind") == "string", F.col("avg_length")).alias("avg_length"),
    )


def top_values(cells: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent strings per column; ties go to the one seen first."""
    counts = cells.where("kind = 'string'").groupBy("coll", "field", "s").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    w = Window.partitionBy("coll", "field").orderBy(F.desc("n"), "first_ord")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("coll", "field", "rank", F.col("s").alias("value"), "n")


def moments(cells: DataFrame) -> DataFrame:
    """Mean, sample variance and deviation, median and quartiles (linear
    interpolation) of the finite numbers per column."""
    return cells.where("x is not null").groupBy("coll", "field").agg(
        F.avg("x").alias("mean"),
        F.var_samp("x").alias("variance"),
        F.stddev_samp("x").alias("stdev"),
        F.median("x").alias("median"),
        F.percentile("x", F.lit(0.25)).alias("p25"),
        F.percentile("x", F.lit(0.75)).alias("p75"),
    )


def numeric_stats(cells: DataFrame) -> DataFrame:
    """Min, max, exact sum and count of each numeric column over all rows; sums
    are decimal, so their order does not matter."""
    num = cells.where("kind = 'numeric'")
    return num.groupBy("coll", "field").agg(
        F.min("x").alias("min"), F.max("x").alias("max"), F.sum(F.col("s").cast("decimal(30,6)")).cast("double").alias("sum"), F.count("*").alias("count")
    )


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters of a string over the logarithm of the
    number of distinct ones; 0 for fewer than two characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    kinds = F.size(F.array_distinct(chars))
    return F.when((F.size(chars) >= 2) & (kinds >= 2), shannon_bits(text) / F.log2(kinds)).otherwise(F.lit(0.0))


def anomalies(cells: DataFrame, sigmas: float = SIGMAS) -> DataFrame:
    """(coll, field, ord, x) of numbers more than ``sigmas`` deviations off
    their column's mean."""
    stats = cells.where("x is not null").groupBy("coll", "field").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"))
    return cells.where("x is not null").join(stats, ["coll", "field"]).where(F.abs(F.col("x") - F.col("m")) > sigmas * F.col("sd")).where("sd > 0").select("coll", "field", "ord", "x")


def change_points(cells: DataFrame, window: int = CHANGE_WINDOW, sigmas: float = SIGMAS) -> DataFrame:
    """(coll, field, pos): positions among a column's finite numbers where the
    means of the ``window`` values before and from there differ by more than
    ``sigmas`` deviations, thinned so that kept ones lie over ``window`` apart."""
    by = Window.partitionBy("coll", "field").orderBy("ord")
    whole = Window.partitionBy("coll", "field")
    seen = (
        cells.where("x is not null")
        .withColumn("pos", F.row_number().over(by) - 1)
        .withColumn("before", F.avg("x").over(by.rowsBetween(-window, -1)))
        .withColumn("after", F.avg("x").over(by.rowsBetween(0, window - 1)))
        .withColumn("n", F.count("*").over(whole))
        .withColumn("sd", F.stddev_samp("x").over(whole))
        .where(f"pos >= {window} and pos < n - {window} and sd > 0")
        .where(F.abs(F.col("after") - F.col("before")) > sigmas * F.col("sd"))
    )
    thin = F.aggregate(
        F.sort_array(F.collect_list("pos")),
        F.expr("cast(array() as array<int>)"),
        lambda kept, p: F.when((F.size(kept) == 0) | (p - F.element_at(kept, -1) > window), F.concat(kept, F.array(p))).otherwise(kept),
    )
    return seen.groupBy("coll", "field").agg(thin.alias("p")).select("coll", "field", F.explode("p").alias("pos"))


def sequential(cells: DataFrame) -> DataFrame:
    """(coll, field, is_sequential): at least five numbers whose sorted steps
    average within [0.5, 2], over 80% of them in that range, and over 70% of the
    neighbours in source order ascending."""
    num = cells.where("x is not null")
    by_value = Window.partitionBy("coll", "field").orderBy("x", "ord")
    by_ord = Window.partitionBy("coll", "field").orderBy("ord")
    steps = num.withColumn("step", F.col("x") - F.lag("x").over(by_value)).withColumn("rise", (F.col("x") >= F.lag("x").over(by_ord)).cast("double"))
    good = F.avg(F.when(F.col("step").isNotNull(), F.col("step").between(0.5, 2.0).cast("double")))
    return steps.groupBy("coll", "field").agg(((F.count("*") >= 5) & F.avg("step").between(0.5, 2.0) & (good > 0.8) & (F.avg("rise") > 0.7)).alias("is_sequential"))


def _head(cells: DataFrame, n: int, known_only: bool = False) -> DataFrame:
    rows = cells.where("kind != 'null'") if known_only else cells
    w = Window.partitionBy("coll", "field").orderBy("ord")
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def temporal(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """(coll, field, is_temporal): most of the first ten values are ISO dates or
    times, or all numbers lie in one plausible range of epoch seconds or
    milliseconds."""
    w = Window.partitionBy("coll", "field").orderBy("ord")
    first = cells.withColumn("_rn", F.row_number().over(w)).where("_rn <= 10 and kind = 'string'")
    iso = first.groupBy("coll", "field").agg(F.avg((F.col("s").rlike(ISO_DATETIME) | F.col("s").rlike(ISO_DATE)).cast("double")).alias("iso"))
    epoch = (F.col("min_val").between(1e9, 2e9) & F.col("max_val").between(1e9, 2e9)) | (F.col("min_val").between(1e12, 2e12) & F.col("max_val").between(1e12, 2e12))
    is_t = F.when(F.col("field_type") == "string", F.coalesce(F.col("iso") > 0.5, F.lit(False))).when(F.col("field_type") == "numeric", F.coalesce(epoch, F.lit(False))).otherwise(F.lit(False))
    return stats.join(iso, ["coll", "field"], "left").select("coll", "field", is_t.alias("is_temporal"))


def id_fields(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """(coll, field, is_id, confidence) of columns that look like identifiers."""
    sample = _head(cells, 20).where("kind = 'string'").groupBy("coll", "field").agg(F.avg(F.col("s").rlike(UUID).cast("double")).alias("uuid"), F.avg(entropy(F.col("s"))).alias("ent"))
    j = stats.join(sample, ["coll", "field"], "left").join(sequential(cells), ["coll", "field"], "left")
    r, text, num = F.col("unique_ratio"), F.col("field_type") == "string", F.col("field_type") == "numeric"
    conf = (
        F.when(r < 0.9, 0.0)
        .when(text & (F.col("uuid") > 0.8), 0.95)
        .when(text & (F.col("ent") > 0.7) & (r > 0.95), 0.8)
        .when(num & F.col("is_sequential") & (r > 0.95), 0.9)
        .when(num & (F.col("max_val") - F.col("min_val") > 0) & (r > 0.95), 0.85)
        .when(r > 0.98, 0.7)
        .otherwise(0.0)
    )
    return j.select("coll", "field", (conf > 0).alias("is_id"), conf.alias("confidence"))


def score_fields(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """(coll, field, is_score, confidence): bounded, varying, not sequential;
    falling order and fractions add to the confidence."""
    by = Window.partitionBy("coll", "field").orderBy("ord")
    nums = cells.where("x is not null").withColumn("pos", F.row_number().over(by)).withColumn("prev", F.lag("x").over(by))
    shape = nums.groupBy("coll", "field").agg(
        F.count("*").alias("k"),
        F.avg(F.when(F.col("prev").isNotNull(), (F.col("prev") >= F.col("x")).cast("double"))).alias("falling"),
        F.avg(F.when(F.col("pos") <= 20, (F.col("x") != F.signum("x") * F.floor(F.abs("x"))).cast("double"))).alias("fraction"),
    )
    seq = sequential(_head(cells, 50)).withColumnRenamed("is_sequential", "seq50")
    j = stats.where("field_type = 'numeric'").join(shape, ["coll", "field"], "left").join(seq, ["coll", "field"], "left")
    lo, hi = F.col("min_val"), F.col("max_val")
    base = F.when((lo >= 0) & (hi <= 1), 0.4).when((lo >= 0) & (hi <= 10), 0.3).when((lo >= 0) & (hi <= 100), 0.25).when((lo >= -1) & (hi <= 1), 0.35)
    conf = base + F.when((F.col("k") >= 5) & (F.col("falling") > 0.7), 0.3).otherwise(0.0) + F.when(F.col("fraction") > 0.3, 0.1).otherwise(0.0)
    ok = (F.col("unique_count") > 1) & (F.col("variance") > 0) & base.isNotNull() & ~F.coalesce("seq50", F.lit(False))
    conf = F.when(ok, conf).otherwise(0.0)
    return j.select("coll", "field", (conf >= 0.4 - 1e-9).alias("is_score"), F.least(conf, F.lit(0.95)).alias("confidence"))


def field_roles(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """(coll, field, role): constant, varying-identity (near-unique and shaped
    like dates, ids, hashes or counters) or content. The columns of the middle
    role are left out when rows are compared."""
    head = _head(cells, 20, known_only=True)
    s = F.col("s")
    shaped = s.rlike(ISO_DATETIME) | s.rlike(ISO_DATE) | s.rlike(UUID) | s.rlike(HEX_RUN)
    letters = F.length(F.regexp_replace(s, r"[^A-Za-z]", ""))
    vowels = F.length(F.regexp_replace(s, r"[^AEIOUaeiou]", ""))
    odd = s.rlike("[0-9]") | (letters == 0) | (vowels / letters < 0.25)
    sample = head.where("kind = 'string'").groupBy("coll", "field").agg(
        F.avg(shaped.cast("double")).alias("shaped"),
        F.min((s.rlike(r"^\S+$")).cast("int")).alias("tokens"),
        F.avg(entropy(s)).alias("ent"),
        F.avg(F.coalesce(odd, F.lit(True)).cast("double")).alias("odd"),
    )
    j = stats.join(sample, ["coll", "field"], "left").join(sequential(head), ["coll", "field"], "left")
    text = (F.col("shaped") >= 0.8) | ((F.col("tokens") == 1) & (F.col("ent") > 0.85) & (F.col("odd") >= 0.8))
    identity = F.when(F.col("field_type") == "string", text).when(F.col("field_type") == "numeric", F.col("is_sequential")).otherwise(F.lit(False))
    role = F.when(F.col("is_constant"), "constant").when((F.col("unique_ratio") >= 0.9) & F.coalesce(identity, F.lit(False)), "varying-identity").otherwise("content")
    return j.select("coll", "field", role.alias("role"))


def patterns(cells: DataFrame, stats: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """(coll, pattern): time_series, logs, search_results or generic. ``scores``
    is what :func:`score_fields` gives, if it is there already."""
    scores = score_fields(cells, stats) if scores is None else scores
    j = stats.join(temporal(cells, stats), ["coll", "field"]).join(scores, ["coll", "field"], "left")
    text = F.col("field_type") == "string"
    message = text & (F.col("unique_ratio") > 0.5) & (F.col("avg_length") > 20)
    level = text & ~message & (F.col("unique_ratio") < 0.1) & F.col("unique_count").between(2, 10)
    some = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    agg = j.groupBy("coll").agg(
        some(F.col("is_temporal")).alias("t"),
        some((F.col("field_type") == "numeric") & (F.col("variance") > 0)).alias("v"),
        some(message).alias("m"),
        some(level).alias("l"),
        some(F.col("is_score") & (F.col("confidence") >= 0.5)).alias("s"),
    )
    return agg.select("coll", F.when(F.col("t") & F.col("v"), "time_series").when(F.col("m") & F.col("l"), "logs").when(F.col("s"), "search_results").otherwise("generic").alias("pattern"))


#: Words that make a row worth keeping. Fixed values.
ERROR_KEYWORDS = ("error", "exception", "failed", "failure", "critical", "fatal", "crash", "panic", "abort", "timeout", "denied", "rejected")


def error_rows(cells: DataFrame) -> DataFrame:
    """(coll, ord) of rows with an error word in a name or a value."""
    words = "|".join(ERROR_KEYWORDS)
    return cells.where(F.lower(F.concat_ws(" ", "field", "s")).rlike(words)).select("coll", "ord").distinct()


def _rare_values(cells: DataFrame) -> DataFrame:
    """(coll, field, v): the rare values of :func:`rare_status`; v is
    ``__none__`` for null."""
    sizes = cells.groupBy("coll").agg(F.count_distinct("ord").alias("n"))
    counts = cells.groupBy("coll", "field", F.coalesce("s", F.lit("__none__")).alias("v")).agg(F.count("*").alias("c"), F.max((F.col("kind") != "null").cast("int")).alias("known"))
    by = Window.partitionBy("coll", "field")
    return (
        counts.withColumn("total", F.sum("c").over(by))
        .withColumn("kinds", F.sum("known").over(by))
        .withColumn("ahead", F.coalesce(F.sum("c").over(by.orderBy(F.desc("c"), "v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("top", F.col("ahead") < F.ceil(F.col("total") * 0.8))
        .withColumn("n_top", F.sum(F.col("top").cast("int")).over(by))
        .join(sizes, "coll")
        .where("kinds between 2 and 50 and n_top <= 5 and total >= 0.8 * n and not top")
        .select("coll", "field", "v")
    )


def rare_status(cells: DataFrame) -> DataFrame:
    """(coll, ord, field, value) of rows with a rare value in a column that at
    least 80% of the rows have and that holds 2 to 50 values, the fewest most
    frequent of which, at most five, cover 80% of the rows."""
    ranked = _rare_values(cells)
    return cells.withColumn("v", F.coalesce("s", F.lit("__none__"))).join(ranked, ["coll", "field", "v"]).select("coll", "ord", "field", F.col("v").alias("value"))


def _rare_fields(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """(coll, field) of columns that under 20% of the rows have."""
    return cells.where("kind != 'null'").groupBy("coll", "field").agg(F.count("*").alias("c")).join(sizes, "coll").where("c < 0.2 * n").select("coll", "field")


def structural_outliers(cells: DataFrame) -> DataFrame:
    """(coll, ord): rows with a column that under 20% of the rows have, or with
    a rare status; only in collections of five rows or more. A null cell here
    is an absent field: drop those cells first if null is a value."""
    sizes = cells.groupBy("coll").agg(F.count_distinct("ord").alias("n")).where("n >= 5")
    by_field = cells.where("kind != 'null'").join(_rare_fields(cells, sizes), ["coll", "field"]).select("coll", "ord")
    by_value = rare_status(cells).join(sizes.select("coll"), "coll", "left_semi").select("coll", "ord")
    return by_field.unionByName(by_value).distinct()


def _with_outliers(cells: DataFrame) -> DataFrame:
    """The collections that :func:`structural_outliers` finds rows of: a rare
    column or value is in some row, so no row has to be looked up."""
    sizes = cells.groupBy("coll").agg(F.count_distinct("ord").alias("n")).where("n >= 5")
    by_value = _rare_values(cells).join(sizes.select("coll"), "coll", "left_semi").select("coll")
    return _rare_fields(cells, sizes).select("coll").unionByName(by_value)


def _with_anomalies(cells: DataFrame, sigmas: float = SIGMAS) -> DataFrame:
    """The collections that :func:`anomalies` finds numbers of: the least or the
    greatest number of a column is the farthest off."""
    m, sd = F.col("m"), F.col("sd")
    stats = cells.where("x is not null").groupBy("coll", "field").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return stats.where((sd > 0) & (F.greatest(m - F.col("lo"), F.col("hi") - m) > sigmas * sd)).select("coll")


def crushability(cells: DataFrame, stats: DataFrame, scores: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """(coll, crushable, confidence, reason): whether dropping rows is safe, by
    uniqueness of the columns and by signals (score column, outliers, error
    words, anomalies, change points). Six cases, the first that fits. ``scores``
    and ``changes`` are what :func:`score_fields` and :func:`change_points` give,
    if they are there already."""
    ids = id_fields(cells, stats).where("is_id").join(stats.select("coll", "field", "unique_ratio"), ["coll", "field"])
    w = Window.partitionBy("coll").orderBy(F.desc("confidence"), "field")
    best = ids.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("coll", F.col("field").alias("id_field"), F.col("unique_ratio").alias("id_ratio"), F.col("confidence").alias("id_conf"))
    rest = stats.join(best, "coll", "left").where(~F.col("field").eqNullSafe(F.col("id_field")))
    ratio = lambda t: F.coalesce(F.avg(F.when(F.col("field_type") == t, F.col("unique_ratio"))), F.lit(0.0))
    uniq = rest.groupBy("coll").agg(ratio("string").alias("us"), ratio("numeric").alias("un"))
    flag = lambda d, name: d.select("coll").distinct().withColumn(name, F.lit(True))
    j = stats.select("coll").distinct().join(best, "coll", "left").join(uniq, "coll", "left")
    for d, name in (
        ((score_fields(cells, stats) if scores is None else scores).where("is_score"), "g1"),
        (_with_outliers(cells), "g2"),
        (error_rows(cells), "g3"),
        (_with_anomalies(cells), "g4"),
        (change_points(cells) if changes is None else changes, "g5"),
    ):
        j = j.join(flag(d, name), "coll", "left")
    j = j.fillna(False, ["g1", "g2", "g3", "g4", "g5"]).fillna(0.0, ["us", "un", "id_ratio", "id_conf"])
    has_id = F.col("id_conf") >= 0.7
    top, content = F.greatest("us", "id_ratio"), F.greatest("us", "un")
    signal = F.col("g1") | F.col("g2") | F.col("g3") | F.col("g4") | F.col("g5")
    case = (
        F.when((content < 0.1) & has_id, F.struct(F.lit(True), F.lit(0.85), F.lit("repetitive_content_with_ids")))
        .when(top < 0.3, F.struct(F.lit(True), F.lit(0.9), F.lit("low_uniqueness_safe_to_sample")))
        .when(has_id & (top > 0.8) & ~signal, F.struct(F.lit(False), F.lit(0.85), F.lit("unique_entities_no_signal")))
        .when((top > 0.8) & signal, F.struct(F.lit(True), F.lit(0.7), F.lit("unique_entities_with_signal")))
        .when(~signal, F.struct(F.lit(False), F.lit(0.6), F.lit("medium_uniqueness_no_signal")))
        .otherwise(F.struct(F.lit(True), F.lit(0.5), F.lit("medium_uniqueness_with_signal")))
    )
    return j.select("coll", case.alias("c")).select("coll", F.col("c.col1").alias("crushable"), F.col("c.col2").alias("confidence"), F.col("c.col3").alias("reason"))


def strategies(cells: DataFrame, stats: DataFrame, least: int = 5) -> DataFrame:
    """(coll, pattern, strategy, est_reduction): none below ``least`` rows, skip
    when dropping is not safe, else by pattern."""
    scores, found = written(score_fields(cells, stats)), written(change_points(cells).select("coll").distinct())
    changes = found.withColumn("changes", F.lit(True))
    msg = stats.where("lower(field) like '%message%'").groupBy("coll").agg(F.min_by("unique_ratio", "field").alias("msg"))
    sizes = stats.groupBy("coll").agg(F.max("count").alias("n"), F.avg(F.col("is_constant").cast("double")).alias("const"))
    j = patterns(cells, stats, scores).join(crushability(cells, stats, scores, found), "coll").join(sizes, "coll").join(changes, "coll", "left").join(msg, "coll", "left")
    p = F.col("pattern")
    strategy = (
        F.when(F.col("n") < least, "none")
        .when(~F.col("crushable"), "skip")
        .when((p == "time_series") & F.coalesce("changes", F.lit(False)), "time_series")
        .when((p == "logs") & (F.col("msg") < 0.5), "cluster_sample")
        .when(p == "search_results", "top_n")
        .otherwise("smart_sample")
    )
    base = F.when(strategy == "time_series", 0.7).when(strategy == "cluster_sample", 0.8).when(strategy == "top_n", 0.6).when(strategy == "smart_sample", 0.5).otherwise(0.3)
    est = F.when(strategy.isin("none", "skip"), 0.0).otherwise(F.least(base + F.col("const") * 0.2, F.lit(0.95)))
    return j.select("coll", "pattern", strategy.alias("strategy"), est.alias("est_reduction"))
