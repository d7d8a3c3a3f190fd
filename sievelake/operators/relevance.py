"""Relevance and search.

Two BM25 scorers that differ in the weight of a term: a constant, or the
corpus's inverse document frequency. A query has few terms, so a document needs
only its length and their counts: these are computed inside the row, and the
corpus statistics are one small aggregate. No token is ever shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.text import TOKEN, lines, tokens
from sievelake.shared import written

K1, B, MOST, LONG = 1.5, 0.75, 10.0, 8


def query_terms(query: str) -> dict[str, int]:
    return dict(Counter(re.findall(TOKEN, query.lower())))


def _counted(docs: DataFrame, text: str, terms: dict[str, int]) -> DataFrame:
    toks = F.col("_toks")
    # A generated column: texts are cut into tokens once, not once per term.
    found = F.coalesce(tokens(F.col(text)), F.expr("cast(array() as array<string>)"))
    out = docs.select("*", F.explode(F.array(found)).alias("_toks")).withColumn("_len", F.size("_toks"))
    tf = [F.size(F.array_remove(toks, t)) for t in terms]
    tf = [(F.col("_len") - n).cast("double") for n in tf]
    return out.withColumn("_tf", F.array(*tf) if tf else F.expr("cast(array() as array<double>)")).drop("_toks")


def _finish(raw: Column, tf: Column, terms: dict[str, int]) -> Column:
    long_hit = F.lit(False)
    for i, t in enumerate(terms):
        if len(t) >= LONG:
            long_hit = long_hit | (tf[i] > 0)
    s = F.least(F.lit(1.0), raw / MOST)
    return F.when(long_hit, F.least(F.lit(1.0), s + 0.3)).otherwise(s)


def _sum(tf: Column, length: Column, avg: Column, idf: list[Column], terms: dict[str, int]) -> Column:
    out = F.lit(0.0)
    for i, q in enumerate(terms.values()):
        f = tf[i]
        out = out + F.when(f > 0, idf[i] * f * (K1 + 1) / (f + K1 * (1 - B + B * length / avg)) * q).otherwise(0.0)
    return out


def bm25_const(docs: DataFrame, text: str, query: str) -> DataFrame:
    """Adds bm25 and matched (number of query terms found); every term weighs
    ln 2. The mean length of all rows is one row, joined to every task."""
    terms = query_terms(query)
    d = _counted(docs, text, terms)
    j = d.crossJoin(F.broadcast(d.agg(F.avg("_len").alias("_avg"))))  # one row
    score = _sum(F.col("_tf"), F.col("_len"), F.col("_avg"), [F.lit(math.log(2.0))] * len(terms), terms)
    return j.withColumn("bm25", _finish(score, F.col("_tf"), terms)).withColumn("matched", F.size(F.filter("_tf", lambda x: x > 0))).drop("_tf", "_len", "_avg")


def bm25_corpus(docs: DataFrame, text: str, query: str) -> DataFrame:
    """Adds bm25 and matched, with inverse document frequencies over all rows of
    ``docs``. The statistics are one row, joined to every task."""
    terms = query_terms(query)
    return _scored(_counted(docs, text, terms), terms)


def _scored(d: DataFrame, terms: dict[str, int]) -> DataFrame:
    if not terms:
        return d.withColumn("bm25", F.lit(0.0)).withColumn("matched", F.lit(0)).drop("_tf", "_len")
    stats = d.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), F.array(*[F.sum((F.col("_tf")[i] > 0).cast("double")) for i in range(len(terms))]).alias("_df"))
    j = d.crossJoin(F.broadcast(stats))  # one row
    idf = [F.log((F.col("_n") - F.col("_df")[i] + 0.5) / (F.col("_df")[i] + 0.5) + 1.0) for i in range(len(terms))]
    score = _sum(F.col("_tf"), F.col("_len"), F.col("_avg"), idf, terms)
    return j.withColumn("bm25", _finish(score, F.col("_tf"), terms)).withColumn("matched", F.size(F.filter("_tf", lambda x: x > 0))).drop("_tf", "_len", "_n", "_avg", "_df")


def hybrid(score: Column, matched: Column) -> Column:
    """Any match counts at least 0.3; two or more add 0.2."""
    s = F.greatest(score, F.lit(0.3))
    return F.when(matched == 0, score).when(matched >= 2, F.least(F.lit(1.0), s + 0.2)).otherwise(s)


def search_all(docs: DataFrame, key: str, text: str, query: str, most: int = 10) -> DataFrame:
    """The best documents of the corpus: (key, score), ties to the smaller key."""
    terms = query_terms(query)
    # Counts are read for the statistics and for the scores: texts are cut into tokens once.
    counted = written(_counted(docs.select(key, text), text, terms).drop(text))
    scored = _scored(counted, terms).where("bm25 > 0")
    return scored.select(key, F.col("bm25").alias("score")).orderBy(F.desc("score"), key).limit(most)


def search_within(items: DataFrame, entry: str, ord: str, text: str, query: str, most: int = 20, least: float = 0.3) -> DataFrame:
    """The best items of each entry, scored against that entry's items."""
    terms = query_terms(query)
    d = _counted(items, text, terms)
    by = Window.partitionBy(entry)
    n, avg = F.count("*").over(by), F.avg("_len").over(by)
    df = [F.sum((F.col("_tf")[i] > 0).cast("double")).over(by) for i in range(len(terms))]
    d = d.withColumn("_n", n).withColumn("_avg", avg).withColumn("_df", F.array(*df))
    idf = [F.log((F.col("_n") - F.col("_df")[i] + 0.5) / (F.col("_df")[i] + 0.5) + 1.0) for i in range(len(terms))]
    scored = d.withColumn("score", _finish(_sum(F.col("_tf"), F.col("_len"), F.col("_avg"), idf, terms), F.col("_tf"), terms)).where(F.col("score") >= least)
    rank = F.row_number().over(by.orderBy(F.desc("score"), ord))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select(entry, ord, "score", "rank")


def items_json(docs: DataFrame, key: str, text: str, depth: int = 3) -> DataFrame:
    """(key, path, value): scalar leaves of a JSON document down to ``depth``
    levels; containers below are one leaf."""
    level = docs.select(key, F.lit("").alias("path"), F.try_parse_json(F.col(text)).alias("v")).where("v is not null")
    done = None
    for _ in range(depth):
        kind = F.schema_of_variant("v")
        obj, arr = kind.startswith("OBJECT"), kind.startswith("ARRAY")
        leaf = level.where(~obj & ~arr & (kind != "VOID")).select(key, "path", F.to_json("v").alias("value"))
        done = leaf if done is None else done.unionByName(leaf)
        keys = F.json_object_keys(F.to_json("v"))
        objs = level.where(obj).select(key, "path", "v", F.explode(keys).alias("k"))
        objs = objs.select(key, F.concat("path", F.when(F.col("path") == "", "").otherwise("."), "k").alias("path"), F.expr("try_variant_get(v, concat('$[\"', k, '\"]'), 'variant')").alias("v"))
        arrs = level.where(arr).select(key, "path", F.posexplode(F.expr("try_variant_get(v, '$', 'array<variant>')")).alias("i", "v"))
        arrs = arrs.select(key, F.concat("path", F.lit("["), F.col("i").cast("string"), F.lit("]")).alias("path"), "v")
        level = objs.unionByName(arrs)
    rest = level.where("schema_of_variant(v) != 'VOID'").select(key, "path", F.to_json("v").alias("value"))
    return done.unionByName(rest)


def items_words(docs: DataFrame, key: str, text: str, size: int = 350, overlap: int = 50) -> DataFrame:
    """(key, chunk, word_start, word_end, chunk_text): windows of words; a text
    of no more than ``size`` words is one chunk."""
    words = F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda w: w != "")
    d = docs.select(key, words.alias("_w")).where(F.size("_w") > 0)
    step = size - overlap
    last = F.when(F.size("_w") <= size, 0).otherwise(F.ceil((F.size("_w") - size) / step).cast("int"))
    c = d.select(key, "_w", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    start = F.col("chunk") * step
    return c.select(key, "chunk", (start + 1).alias("word_start"), F.least(start + size, F.size("_w")).alias("word_end"), F.array_join(F.slice("_w", start + 1, F.lit(size)), " ").alias("chunk_text"))


def items_lines(docs: DataFrame, key: str, text: str, most: int = 2000) -> DataFrame:
    """(key, chunk, line_start, line_end): lines packed greedily into chunks of
    at most ``most`` characters; a longer line is a chunk of its own."""
    sizes = F.transform(lines(F.col(text)), lambda x: F.length(x) + 1)
    zero = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<int>)").alias("starts"), F.lit(1).alias("line"))
    packed = F.aggregate(
        sizes,
        zero,
        lambda a, n: F.struct(
            F.when((a["used"] > 0) & (a["used"] + n > most), n).otherwise(a["used"] + n).alias("used"),
            F.when((a["used"] == 0) | (a["used"] + n > most), F.concat(a["starts"], F.array(a["line"]))).otherwise(a["starts"]).alias("starts"),
            (a["line"] + 1).alias("line"),
        ),
    )
    d = docs.where(F.trim(F.col(text)) != "").select(key, packed.alias("p"))
    out = d.select(key, "p", F.posexplode("p.starts").alias("chunk", "line_start"))
    nxt = F.try_element_at(F.col("p.starts"), F.col("chunk") + 2)
    return out.select(key, "chunk", "line_start", (F.coalesce(nxt, F.col("p.line")) - 1).alias("line_end"))


def numeric_loss(text: Column) -> Column:
    """True if a number literal of the text changes when read as a double."""
    found = F.regexp_extract_all(text, F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return F.exists(found, lambda x: (F.length(F.regexp_replace(x, "[^0-9]", "")) <= 38) & (x.try_cast("decimal(38,10)") != x.try_cast("double").try_cast("decimal(38,10)")))


def substring_search(docs: DataFrame, key: str, text: str, newest: str, needle: str, most: int) -> DataFrame:
    """Documents that contain the needle in any case, newest first."""
    return docs.where(F.contains(F.lower(F.col(text)), F.lit(needle.lower()))).orderBy(F.desc(newest), key).limit(most)


def preview(text: Column, needle: str, around: int = 40) -> Column:
    """The text around the first hit, with dots where it was cut; its head if
    there is no hit."""
    at = F.locate(needle.lower(), F.lower(text))
    lo = F.greatest(at - around, F.lit(1))
    cut = F.substring(text, lo, F.lit(len(needle) + 2 * around))
    hit = F.concat(F.when(lo > 1, "...").otherwise(""), cut, F.when(lo + len(needle) + 2 * around - 1 < F.length(text), "...").otherwise(""))
    return F.when(at > 0, hit).otherwise(F.substring(text, 1, 2 * around))
