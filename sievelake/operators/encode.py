"""Lossless column encodings with decoders.

Every encoder works on the long form (coll, field, ord, s) of a collection and
gives cells plus what the decoder needs; ``ord`` is the position that encodings
refer to. All are windows or aggregates by (coll, field): a column of one
collection is the unit of work, never a whole table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.text import parse_iso, render_iso, split_head

BY = ("coll", "field")


def _order() -> Window:
    return Window.partitionBy(*BY).orderBy("ord")


def type_tags(cells: DataFrame) -> DataFrame:
    """(coll, field, tag, nullable): int, float, string, bool, json or null;
    columns of several types are json."""
    whole = F.col("s").rlike(r"^-?[0-9]+$")
    tag = F.when(F.col("kind") == "numeric", F.when(whole, "int").otherwise("float")).when(F.col("kind") == "boolean", "bool").when(F.col("kind").isin("object", "array"), "json").otherwise(F.col("kind"))
    g = cells.withColumn("tag", tag).groupBy(*BY).agg(F.collect_set(F.when(F.col("kind") != "null", F.col("tag"))).alias("tags"), F.max((F.col("kind") == "null").cast("int")).alias("n"))
    mixed = F.when(F.size("tags") == 0, "null").when(F.size("tags") == 1, F.col("tags")[0]).when(F.array_except("tags", F.array(F.lit("int"), F.lit("float"))) == F.array().cast("array<string>"), "float").otherwise("json")
    return g.select(*BY, mixed.alias("tag"), (F.col("n") == 1).alias("nullable"))


def constants(cells: DataFrame) -> DataFrame:
    """(coll, field, value) of columns with one non-empty value in all of two or
    more rows."""
    g = cells.groupBy(*BY).agg(F.count("*").alias("n"), F.count("s").alias("k"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    return g.where("n >= 2 and k = n and lo = hi and lo != ''").select(*BY, F.col("lo").alias("value"))


def arithmetic(cells: DataFrame) -> DataFrame:
    """(coll, field, base, step, n) of integer columns that are base + step * i
    over three rows or more, step not 0."""
    whole = cells.withColumn("v", F.when(F.col("s").rlike(r"^(0|-?[1-9][0-9]{0,17})$"), F.col("s").try_cast("bigint"))).withColumn("d", F.col("v") - F.lag("v").over(_order()))
    g = whole.groupBy(*BY).agg(F.count("*").alias("n"), F.count("v").alias("k"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.min_by("v", "ord").alias("base"))
    return g.where("n >= 3 and k = n and lo = hi and lo != 0").select(*BY, "base", F.col("lo").alias("step"), "n")


def decode_arithmetic(encoded: DataFrame) -> DataFrame:
    return encoded.select(*BY, F.posexplode(F.expr("transform(sequence(0, cast(n - 1 as int)), i -> cast(base + step * i as string))")).alias("pos", "s"))


def iso_deltas(cells: DataFrame) -> DataFrame:
    """(coll, field, ord, cell): the first time in full, then the seconds since
    the row before; only columns whose every value is a time that its decoder
    writes the same way."""
    t = cells.withColumn("t", parse_iso(F.col("s")))
    t = t.withColumn("ok", F.col("t").isNotNull() & (F.col("s") == render_iso(F.col("t"))))
    t = t.withColumn("all", F.min(F.coalesce(F.col("ok"), F.lit(False)).cast("int")).over(Window.partitionBy(*BY))).where("all = 1")
    d = F.col("t") - F.lag("t").over(_order())
    cell = F.when(d.isNull(), F.col("s")).otherwise(F.concat(F.when(d >= 0, "+").otherwise(""), d.cast("string")))
    return t.select(*BY, "ord", cell.alias("cell"))


def decode_iso(encoded: DataFrame) -> DataFrame:
    secs = F.coalesce(parse_iso(F.col("cell")), F.col("cell").try_cast("bigint"))
    return encoded.select(*BY, "ord", render_iso(F.sum(secs).over(_order())).alias("s"))


def decimals(cells: DataFrame) -> DataFrame:
    """(coll, field, k, ord, cell): numbers with up to k digits behind the point
    as whole numbers of units 10^-k, by moving the point in the text. Columns
    where some text is no plain decimal, or no value has a point, are left out."""
    plain = F.col("s").rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$") & ~F.col("s").rlike(r"^-0(\.0*)?$")
    frac = F.regexp_extract("s", r"\.([0-9]+)$", 1)
    w = Window.partitionBy(*BY)
    d = cells.withColumn("frac", frac).withColumn("k", F.max(F.length("frac")).over(w)).withColumn("ok", F.min(F.coalesce(plain, F.lit(False)).cast("int")).over(w)).where("ok = 1 and k between 1 and 12")
    digits = F.concat(F.regexp_extract("s", r"^-?([0-9]+)", 1), F.rpad("frac", F.col("k"), "0"))
    body = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return d.select(*BY, "k", "ord", F.concat(F.when(F.col("s").startswith("-"), "-").otherwise(""), body).alias("cell"), F.length("frac").alias("places"))


def decode_decimals(encoded: DataFrame) -> DataFrame:
    """Back to the shortest text with at least one digit behind the point."""
    sign = F.when(F.col("cell").startswith("-"), "-").otherwise("")
    digits = F.regexp_replace("cell", "^-", "")
    padded = F.lpad(digits, F.greatest(F.length(digits), F.col("k") + 1), "0")
    head = F.substring(padded, F.lit(1), F.length(padded) - F.col("k"))
    tail = F.substring(padded, F.length(padded) - F.col("k") + 1, F.col("places"))
    return encoded.select(*BY, "ord", F.concat(sign, head, F.when(F.col("places") > 0, F.concat(F.lit("."), tail)).otherwise("")).alias("s"))


def dictionary(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, codes): entries (coll, field, code, value) in the order first
    seen, codes (coll, field, ord, code); string columns with at least two
    values and fewer values than rows, none with a line break."""
    values = cells.groupBy(*BY, "s").agg(F.min("ord").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy(*BY)
    ranked = (
        values.withColumn("kinds", F.count("*").over(w)).withColumn("rows", F.sum("n").over(w)).withColumn("bad", F.max((F.col("s").isNull() | F.col("s").contains("\n")).cast("int")).over(w))
        .where("kinds >= 2 and kinds < rows and bad = 0")
        .withColumn("code", F.row_number().over(w.orderBy("first")) - 1)
    )
    entries = ranked.select(*BY, "code", F.col("s").alias("value"))
    return entries, cells.join(entries.withColumnRenamed("value", "s"), [*BY, "s"]).select(*BY, "ord", "code")


def decode_dictionary(entries: DataFrame, codes: DataFrame) -> DataFrame:
    return codes.join(entries, [*BY, "code"]).select(*BY, "ord", F.col("value").alias("s"))


def head_dictionary(cells: DataFrame, least: int = 16) -> tuple[DataFrame, DataFrame]:
    """(heads, codes): values cut behind their last ``/``, ``:`` or ``.``; heads
    in the order first seen, codes (coll, field, ord, code, rest). Columns of at
    least 16 rows with two or more heads and fewer heads than rows."""
    head, rest = split_head(F.col("s"))
    cut = cells.where("s is not null").withColumn("head", head).withColumn("rest", rest)
    h = cut.groupBy(*BY, "head").agg(F.min("ord").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy(*BY)
    heads = (
        h.withColumn("kinds", F.count("*").over(w)).withColumn("rows", F.sum("n").over(w)).withColumn("none", F.max((F.col("head") == "").cast("int")).over(w))
        .where(f"kinds >= 2 and kinds < rows and rows >= {least} and none = 0")
        .withColumn("code", F.row_number().over(w.orderBy("first")) - 1)
        .select(*BY, "code", "head")
    )
    return heads, cut.join(heads, [*BY, "head"]).select(*BY, "ord", "code", "rest")


def decode_heads(heads: DataFrame, codes: DataFrame) -> DataFrame:
    return codes.join(heads, [*BY, "code"]).select(*BY, "ord", F.concat("head", "rest").alias("s"))


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings."""
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.when(n == 0, 0).otherwise(F.size(F.filter(same, lambda x: x)))


def affixes(cells: DataFrame) -> DataFrame:
    """(coll, field, prefix, suffix): what all values begin and end with, two
    characters or more in all; without a value in common they don't overlap.
    The common prefix of all values is that of the least and the greatest."""
    back = F.reverse("s")
    g = cells.groupBy(*BY).agg(F.count("*").alias("n"), F.count("s").alias("k"), F.min("s").alias("lo"), F.max("s").alias("hi"), F.min(back).alias("blo"), F.max(back).alias("bhi"), F.min(F.length("s")).alias("short"))
    g = g.where("n >= 2 and k = n and lo != hi").withColumn("p", _common(F.col("lo"), F.col("hi")))
    g = g.withColumn("q", F.least(_common(F.col("blo"), F.col("bhi")), F.col("short") - F.col("p"))).where("p + q >= 2")
    return g.select(*BY, F.substring("lo", F.lit(1), F.col("p")).alias("prefix"), F.reverse(F.substring("blo", F.lit(1), F.col("q"))).alias("suffix"))


def strip_affixes(cells: DataFrame, found: DataFrame) -> DataFrame:
    p, q = F.length("prefix"), F.length("suffix")
    return cells.join(found, list(BY)).select(*BY, "ord", F.substring("s", p + 1, F.length("s") - p - q).alias("cell"))


def decode_affixes(stripped: DataFrame, found: DataFrame) -> DataFrame:
    return stripped.join(found, list(BY)).select(*BY, "ord", F.concat("prefix", "cell", "suffix").alias("s"))


def ditto(cells: DataFrame) -> DataFrame:
    """(coll, field, ord, cell): a value longer than one character that repeats
    the row before becomes ``=``; a value that is ``=`` itself is escaped."""
    s = F.col("s")
    same = s.eqNullSafe(F.lag("s").over(_order())) & (F.length(s) > 1)
    return cells.select(*BY, "ord", F.when(same, "=").when(s.rlike(r"^\\*=$"), F.concat(F.lit("\\"), s)).otherwise(s).alias("cell"))


def decode_ditto(encoded: DataFrame) -> DataFrame:
    known = F.when(F.col("cell") != "=", F.when(F.col("cell").rlike(r"^\\+=$"), F.substring("cell", F.lit(2), F.length("cell"))).otherwise(F.col("cell")))
    mark = F.when(F.coalesce(F.col("cell") != "=", F.lit(True)), F.struct(known.alias("v")))
    return encoded.select(*BY, "ord", F.last(mark, ignorenulls=True).over(_order())["v"].alias("s"))


def buckets(cells: DataFrame) -> DataFrame:
    """(coll, field, n_buckets): the column that splits a mixed collection best:
    a string in every row, 2 to 8 values and at most 70% as many as rows; more
    buckets win, then the name."""
    sizes = cells.groupBy("coll").agg(F.count_distinct("ord").alias("rows"))
    g = cells.groupBy(*BY).agg(F.count_distinct("s").alias("kinds"), F.count("s").alias("k"), F.min((F.col("kind") == "string").cast("int")).alias("text"))
    good = g.join(sizes, "coll").where("text = 1 and k = rows and kinds between 2 and 8 and kinds <= 0.7 * rows")
    w = Window.partitionBy("coll").orderBy(F.desc("kinds"), "field")
    return good.withColumn("r", F.row_number().over(w)).where("r = 1").select(*BY, F.col("kinds").alias("n_buckets"))


def quoted(c: Column) -> Column:
    """A value as a table cell: quoted if it holds a comma, a quote or a line
    break, or could be read as a sentinel; null and missing are sentinels."""
    needs = c.rlike("[,\"\n\r]") | c.rlike(r"^(__null__|__missing__|=|)$")
    return F.when(c.isNull(), "__null__").when(needs, F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(c)


def compact_plan(cells: DataFrame) -> DataFrame:
    """(coll, field, encoding): the first encoding of the strict order that
    applies: const, arith, iso, decimal, dict, head, affix, else plain. An
    encoding after the constants must also be smaller than the plain cells."""
    plain = cells.groupBy(*BY).agg(F.sum(F.length(F.coalesce("s", F.lit("__null__"))) + 1).alias("plain"))
    cost = lambda d: d.groupBy(*BY)
    ents, codes = dictionary(cells)
    heads, hcodes = head_dictionary(cells)
    aff = affixes(cells)
    sizes = [
        ("const", constants(cells).select(*BY, F.lit(0).alias("c"))),
        ("arith", arithmetic(cells).select(*BY, F.lit(1).alias("c"))),
        ("iso", cost(iso_deltas(cells)).agg(F.sum(F.length("cell") + 1).alias("c"))),
        ("decimal", cost(decimals(cells)).agg(F.sum(F.length("cell") + 1).alias("c"))),
        ("dict", cost(ents).agg(F.sum(F.length("value") + 1).alias("e")).join(cost(codes).agg(F.sum(F.length(F.col("code").cast("string")) + 1).alias("k")), list(BY)).select(*BY, (F.col("e") + F.col("k")).alias("c"))),
        ("head", cost(heads).agg(F.sum(F.length("head") + 1).alias("e")).join(cost(hcodes).agg(F.sum(F.length(F.col("code").cast("string")) + F.length("rest") + 2).alias("k")), list(BY)).select(*BY, (F.col("e") + F.col("k")).alias("c"))),
        ("affix", cost(strip_affixes(cells, aff)).agg(F.sum(F.length("cell") + 1).alias("k")).join(aff, list(BY)).select(*BY, (F.col("k") + F.length("prefix") + F.length("suffix")).alias("c"))),
    ]
    options = None
    for rank, (name, d) in enumerate(sizes):
        part = d.select(*BY, F.lit(rank).alias("rank"), F.lit(name).alias("encoding"), F.col("c").cast("bigint").alias("c"))
        options = part if options is None else options.unionByName(part)
    first = options.join(plain, list(BY)).where("rank = 0 or c < plain").groupBy(*BY).agg(F.min_by("encoding", "rank").alias("encoding"))
    return plain.join(first, list(BY), "left").select(*BY, F.coalesce("encoding", F.lit("plain")).alias("encoding"))


def column_order(cells: DataFrame) -> DataFrame:
    """(coll, field, pos): columns by how many rows have them, then by name."""
    g = cells.groupBy(*BY).agg(F.count("s").alias("k"))
    return g.select(*BY, F.row_number().over(Window.partitionBy("coll").orderBy(F.desc("k"), "field")).alias("pos"))


def _joined(by: str, value: Column, sep: str) -> Column:
    """The values of a group in the order of a column, joined."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(by).alias("o"), value.alias("t")))), lambda x: x["t"]), sep)


def render(cells: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """(coll, text): ``[kept/total]{name:type,...}`` and one line per row, cells
    in the order of :func:`column_order`, a nullable column marked by ``?``."""
    tags = type_tags(cells).join(column_order(cells), list(BY))
    mark = F.concat("field", F.lit(":"), "tag", F.when(F.col("nullable"), "?").otherwise(""))
    head = tags.groupBy("coll").agg(_joined("pos", mark, ",").alias("cols"))
    rows = cells.join(column_order(cells), list(BY)).groupBy("coll", "ord").agg(_joined("pos", quoted(F.col("s")), ",").alias("line"))
    body = rows.groupBy("coll").agg(F.count("*").alias("kept"), _joined("ord", F.col("line"), "\n").alias("body"))
    if total is not None:
        body = body.join(total, "coll")
    n = F.col("total") if total is not None else F.col("kept")
    return body.join(head, "coll").select("coll", F.concat(F.lit("["), F.col("kept").cast("string"), F.lit("/"), n.cast("string"), F.lit("]{"), "cols", F.lit("}\n"), "body").alias("text"))


def render_kv(cells: DataFrame) -> DataFrame:
    """(coll, ord, text): a block of ``- name: value`` lines per row."""
    lines = cells.where("s is not null").join(column_order(cells), list(BY))
    item = F.concat(F.lit("- "), "field", F.lit(": "), "s")
    text = _joined("pos", item, "\n")
    return lines.groupBy("coll", "ord").agg(text.alias("text"))


def stats_lines(stats: DataFrame) -> DataFrame:
    """(coll, text): one ``__stats:`` line of numeric columns' statistics."""
    num = lambda c: F.format_string("%.2f", F.col(c))
    part = F.concat("field", F.lit("(min="), num("min"), F.lit(" max="), num("max"), F.lit(" sum="), num("sum"), F.lit(" n="), F.col("count").cast("string"), F.lit(")"))
    return stats.groupBy("coll").agg(F.concat(F.lit("__stats: "), _joined("field", part, " ")).alias("text"))


def demoted(kept: DataFrame, everything: DataFrame) -> DataFrame:
    """(coll, field) of columns constant among the rows kept but not among all
    rows: their constant must not be stated."""
    return constants(kept).select(*BY).join(constants(everything).select(*BY), list(BY), "left_anti")


def flatten(df: DataFrame, column: str, most: int = 6) -> DataFrame:
    """A struct column as dotted columns, at most six and none that exists."""
    inner = df.schema[column].dataType.fieldNames()
    names = [f"{column}.{n}" for n in inner]
    if len(inner) > most or set(names) & set(df.columns):
        return df
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != column], *[F.col(column)[n].alias(m) for n, m in zip(inner, names)])


def compact_document(docs: DataFrame, key: str, text: str, depth: int = 50) -> DataFrame:
    """(key, compact, tables): every array of two or more objects with the same
    keys, anywhere in a JSON document, as {"cols": [...], "rows": [[...]]}. An
    object of the document that has these two keys itself becomes a table
    without columns, {"cols": [], "rows": [[its cols, its rows]]}. Nesting is
    followed ``depth`` levels; below, objects are only escaped.

    ``tables`` counts both. Texts that are no JSON, repeat a key in an object or
    write a number as JSON would not write it again come back as they are, with
    no tables."""
    kind = docs.schema[key].dataType.simpleString()

    def pack(node, left: int):
        if isinstance(node, dict):
            out = {k: pack(v, left - 1) for k, v in node.items()}
            if list(out) == ["cols", "rows"]:
                count[0] += 1
                return {"cols": [], "rows": [list(out.values())]}
            return out
        if isinstance(node, list):
            if left >= 0 and len(node) >= 2 and all(isinstance(x, dict) and list(x) == list(node[0]) for x in node) and node[0]:
                count[0] += 1
                return {"cols": list(node[0]), "rows": [[pack(v, left - 1) for v in x.values()] for x in node]}
            return [pack(v, left - 1) for v in node]
        return node

    def same(read):
        def number(text: str):
            value = read(text)
            if json.dumps(value) != text:
                raise ValueError(text)
            return value

        return number

    def once(pairs: list[tuple]) -> dict:
        out = dict(pairs)
        if len(out) < len(pairs):
            raise ValueError("repeated key")
        return out

    count = [0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = [], []
            for t in batch.column(1).to_pylist():
                count[0] = 0
                try:
                    node = json.loads(t, parse_int=same(int), parse_float=same(float), object_pairs_hook=once)
                    out.append(json.dumps(pack(node, depth), ensure_ascii=False, separators=(",", ":")))
                    n.append(count[0])
                except (ValueError, TypeError, RecursionError):
                    out.append(t)
                    n.append(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(n, pa.int32())], [key, "compact", "tables"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, compact string, tables int")


def unpack_document(text: str, tables: int = 1) -> str:
    """The decoder of :func:`compact_document`; a text without tables is
    as it was."""
    if not tables:
        return text

    def undo(node):
        if isinstance(node, dict):
            if list(node) == ["cols", "rows"]:
                if not node["cols"]:
                    return dict(zip(("cols", "rows"), map(undo, node["rows"][0])))
                return [dict(zip(node["cols"], [undo(v) for v in r])) for r in node["rows"]]
            return {k: undo(v) for k, v in node.items()}
        return [undo(v) for v in node] if isinstance(node, list) else node

    return json.dumps(undo(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
