import json

from pyspark.sql import functions as F
from sievelake import api
from sievelake.collections import cells
from sievelake.operators import profile as P
from sievelake.operators import reduce as R
from sievelake.operators import relevance as V
from sievelake.operators import select as S


def records(n=60):
    rows = [{"id": i, "level": "info", "msg": f"step {i % 4} done"} for i in range(n)]
    rows[31] = {"id": 31, "level": "error", "msg": "fatal timeout", "trace": "x"}
    return rows


def test_records_keep_errors_and_ends():
    kept = R.keep_records(records())
    assert 31 in kept and {0, 1, 2} <= set(kept) and len(kept) <= R.MAX_ITEMS + 1
    assert R.keep_records([{"a": 1}] * 4) == [0, 1, 2, 3]


def test_numbers_strings_mixed_objects():
    nums = [1.0] * 30 + [500.0] + [1.0] * 30
    assert 30 in R.keep_numbers(nums) and len(R.keep_numbers(nums)) < 40
    strs = ["same line"] * 40 + ["panic here"] + ["same line"] * 10
    assert 40 in R.keep_strings(strs) and len(R.keep_strings(strs)) < 20
    assert R.keep_mixed([1, "a", None, [1]] * 5)
    big = {f"k{i}": "v" * 60 for i in range(60)} | {"bad": "error " * 12}
    assert "bad" in R.keep_object_keys(big) and len(R.keep_object_keys(big)) < 61
    assert R.adaptive_k(["x"] * 5) == 5 and R.adaptive_k(["same"] * 50) == 3
    assert R.find_knee([1, 1, 1]) == 1 and R.find_knee([1, 2]) is None and R.find_knee([1, 2, 3, 4]) is None


def test_everything_dropped_can_be_restored():
    doc = {"data": records(), "deep": {"list": [f"line {i}" for i in range(90)]}, "n": 1}
    text = json.dumps(doc)
    view, how, dropped = R.reduce_text(text)
    assert how == "lossy" and len(view) < len(text) and dropped
    originals = [json.loads(v) for v in dropped.values()]
    assert doc["data"] in originals and doc["deep"]["list"] in originals
    for key in dropped:
        assert key in view and R.content_key(json.loads(dropped[key])) == key
    assert R.reduce_text("not json") == ("not json", "passthrough", {}) and R.reduce_text(None)[1] == "passthrough"


def test_simhash_groups():
    assert R.unique_groups(["the quick brown fox jumps over it"] * 9) == 1
    assert R.unique_groups([f"{w} {w}{w} text of its own {w}" for w in ("alpha", "omega", "kappa", "gamma")]) == 4


def frame(spark, rows):
    return cells(spark.createDataFrame(rows, "coll int, ord int, t string, x double"), "coll", ["t", "x"])


def test_profile_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    c = frame(spark, [(1, 0, None, None), (1, 1, "a", 1.0), (1, 2, "a", inf), (1, 3, None, nan), (2, 0, None, None)])
    s = {(r.coll, r.field): r for r in P.field_stats(c).collect()}
    assert s[1, "t"].unique_count == 2 and s[1, "t"].field_type == "string" and s[2, "t"].field_type == "null" and s[2, "t"].is_constant
    assert (s[1, "x"].min_val, s[1, "x"].max_val, s[1, "x"].variance) == (1.0, 1.0, 0.0)
    assert P.field_stats(c.limit(0)).collect() == [] and P.change_points(c).collect() == []


def test_change_points_by_hand(spark):
    c = frame(spark, [(1, i, "a", 0.0 if i < 20 else 9.0) for i in range(40)])
    assert [r.pos for r in P.change_points(c, sigmas=1.5).collect()] == [19]


def test_prioritize_keeps_errors_over_budget(spark):
    rows = [(1, i, "error here" if i < 30 else f"v{i}", float(i)) for i in range(60)]
    c = frame(spark, rows)
    kept = S.prioritize(c, S.reasons(c, 10), 10).collect()
    assert len([r for r in kept if r.tier == 0]) >= 30
    calm = frame(spark, [(1, i, f"v{i % 7}", 1.0) for i in range(60)])
    assert S.prioritize(calm, S.reasons(calm, 10), 10).count() <= 10


def test_plans_do_not_depend_on_partitions(spark):
    c = frame(spark, [(i % 3, i, f"v{i % 11}", float(i * i % 97)) for i in range(200)])
    a, b = S.reasons(c.repartition(7), 12), S.reasons(c.coalesce(1), 12)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_bm25_prefers_rare_terms(spark):
    df = spark.createDataFrame([(i, f"common word {i}") for i in range(20)] + [(99, "common needle4711"), (100, None), (101, "")], "i int, t string")
    best = V.search_all(df, "i", "t", "common needle4711").collect()
    assert best[0].i == 99 and best[0].score > best[1].score
    assert V.search_all(df, "i", "t", "absent").collect() == [] and V.bm25_corpus(df, "t", "").where("bm25 > 0").count() == 0


def test_engine_round_trip(spark):
    big = json.dumps(records(200))
    log = "\n".join(f"2024-01-01 00:00:{i % 60:02d} INFO user {i} ok" for i in range(200))
    df = spark.createDataFrame([(1, big), (2, log), (3, "short"), (4, None)], "i int, t string")
    views, entries = api.Engine(redact=False).compress(df, "i", "t", 1000)
    v = {r.i: r for r in views.collect()}
    assert v[1].tokens_after < v[1].tokens_before and v[2].tokens_after < v[2].tokens_before and v[3].view == "short" and v[4].view is None
    for i, t in ((1, big), (2, log)):
        assert api.retrieve(entries, v[i].hash_key, 1000).collect()[0].original_content == t
    assert api.retrieve(entries, v[1].hash_key, 10**9).count() == 0
    assert api.retrieve(entries, v[2].hash_key, 1000, {"line_range": [2, 3]}).count() == 2
    back = api.resolve_markers(views.select("i", F.regexp_extract("view", r"(<<ccr:[0-9a-f]+>>)$", 1).alias("t")), "i", "t", entries)
    assert {r.i: r.t for r in back.collect()}[2] == log
    assert api.search(entries, "user 17", 1000).count() >= 1
