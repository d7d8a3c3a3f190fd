import random

from hypothesis import given, settings
from hypothesis import strategies as st
from sievelake.functions import redact as RD
from sievelake.operators import code as C
from sievelake.operators import detect as D
from sievelake.operators import logs as L
from sievelake.operators import prose as R
from sievelake.operators import retrieve as RT
from sievelake.sources import ingest as I


def test_traces():
    rows = ["INFO start", "Traceback (most recent call last):", '  File "a.py", line 1', "    x()", "ValueError: bad", "INFO next", "java.lang.E", "  at a.b.C.d(C.java:1)", "  at a.b.C.e(C.java)", "done"]
    assert L.trace_flags(rows) == [False, True, True, True, True, False, False, True, True, False]
    chained = rows[1:5] + ["", "During handling of the above exception, another exception occurred:", "", *rows[1:5], "INFO"]
    assert L.trace_flags(chained) == [True] * 11 + [False]
    assert sum(L.trace_flags(["Traceback (most recent call last):"] + ["  x"] * 50)) == L.TRACE_LINES


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "7", "<*>", "\\", "\\<*>", ""]), min_size=1, max_size=4).map(" ".join), max_size=25))
def test_templates_are_lossless(rows):
    temps, values = L.mine_templates(rows)
    assert L.unmine(temps, values, [r for r, v in zip(rows, values) if v is None]) == rows


def test_templates_find_the_repetition():
    temps, values = L.mine_templates([f"user {i} logged in from {i * 7}" for i in range(9)] + ["odd line"])
    assert [" ".join(t) for t in temps] == ["user <*> logged in from <*>"] and values[-1] is None


def test_segments_cover_the_text():
    text = "# Head\n\nOne sentence. Another one! lower goes on.\n- item one\n2) item two\n```py\ncode. Here\n```\nLast 3.14 words"
    kinds = [(text[a:b], k) for a, b, k in R.segments(text)]
    assert [k for _, k in kinds] == ["header", "prose", "prose", "item", "item", "fence", "prose"]
    assert kinds[5][0] == "```py\ncode. Here\n```" and kinds[6][0] == "Last 3.14 words"
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("ab. \n#-`!") for _ in range(60))
        spans = R.segments(t)
        assert all(a < b for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        left = t
        for a, b, _ in reversed(spans):
            left = left[:a] + left[b:]
        assert not left.strip()


def test_sections_and_tags_restore():
    text = "Intro here.\n```\nx\n```\n[1,\n2]\na.py:3:hit\nb.py:4:hit\nEnd."
    parts = R.sections(text)
    assert [k for k, _ in parts] == ["prose", "code", "json", "search", "prose"] and "\n".join(p for _, p in parts) == text
    tagged = "a <my-tag x='1'>in\nside</my-tag> b <x:y/> <b>bold</b> ␟"
    clean, blocks = R.protect_tags(tagged)
    assert len(blocks) == 2 and "my-tag" not in clean and R.restore_tags(clean, blocks) == tagged


def test_code():
    src = 'import os\n\n\ndef run(a):\n    """Doc."""\n    x = 1\n    y = 2\n    return x\n\n\nclass K:\n    def m(self):\n        run(1)\n        run(2)\n'
    view, valid = C.truncate(src)
    assert valid and "y = 2" not in view and '"""Doc."""' in view and "x = 1" in view and "run(2)" not in view
    assert C.truncate("def (") == ("def (", False) and C.truncate(None) == (None, False)
    assert C.language(src) == "python" and C.language("nothing here") is None
    scores = {n: s for n, s, _ in C.importance(src, "run")}
    assert scores["run"] == 1.0 and C.importance("(") == []


def test_html():
    page = "<!DOCTYPE html><html><head><script>x</script></head><body><nav>no</nav><h1>T</h1><p>a&amp;b <b>c</b></p><table><tr><td>5</td><td>3</td></tr></table></body></html>"
    assert I.main_text(page) == "T\na&b c\n5 3" and I.main_text("") == "" and I.main_text(None) is None


def test_csv(spark):
    body = "name,note,n\n" + "\n".join(f'"a{"," if i == 4 else ";"} {i}","say ""hi""",{i:03d}' for i in range(30))
    bad = "x,y\n" + "\n".join("1,2,3" for _ in range(80))
    df = spark.createDataFrame([(1, body), (2, bad), (3, "short,a\n1,2"), (4, None), (5, "[" + "1," * 200 + "1]")], "i int, t string")
    assert [tuple(r) for r in I.sniff_csv(df, "i", "t").collect()] == [(1, ",", 30, 3)]
    cells = {(r.row_no, r.field): (r.s, r.kind) for r in I.csv_cells(df, "i", "t").collect()}
    assert cells[4, "name"] == ("a, 4", "string") and cells[4, "note"] == ('say "hi"', "string") and cells[4, "n"] == ("004", "string")


def test_detection_cascade(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n+new\n-old"
    grep = "\n".join(f"src/a.py:{i}:def f" for i in range(9))
    log = "\n".join(f"2024-01-01 00:00:0{i} ERROR bad" for i in range(9))
    py = "import os\nimport re\ndef f(x):\n    return x\nclass A:\n    pass"
    want = {'[{"a": 1}]': "json_array", '{"data": [{"a": 1}], "m": 1}': "json_array", diff: "diff", grep: "search", log: "build", py: "source_code", "Just prose.": "text", "": "text"}
    df = spark.createDataFrame([(k,) for k in want] + [(None,)], "t string")
    got = {r.t: r.c for r in df.select("t", D.content_type(df.t)["content_type"].alias("c")).collect()}
    assert got == want | {None: "text"}


def test_retrieve_spec_and_markers(spark):
    assert RT.parse_spec({"limit": 3, "line_range": [1, 2]})[1] is None and RT.screen_pattern("(a+)+") == "nested_quantifier"
    df = spark.createDataFrame([(1, '[ {"a": [1, "]"]} , 2,"x" ]'), (2, "[1, "), (3, None), (4, "[]")], "i int, t string")
    assert [(r.idx, r.raw) for r in RT.raw_spans(df, "i", "t").collect()] == [(0, '{"a": [1, "]"]}'), (1, "2"), (2, '"x"')]
    rows = spark.createDataFrame([(1, True, 5), (2, None, 1)], "k int, f boolean, n int")
    assert RT.select_equals(rows, "f", None).count() == 1 and RT.select_equals(rows, "n", True).count() == 0 and RT.select_equals(rows, "f", 1).count() == 0


def test_redaction_is_idempotent(spark):
    key = "AKIA" + "A1B2" * 4
    df = spark.createDataFrame([(f"k {key} ghp_{'a' * 24} ok", 1), (None, 2)], "t string, i int")
    once = df.select(RD.redact(df.t).alias("t"))
    assert [r.t for r in once.collect()] == ["k [REDACTED:aws-access-key] [REDACTED:github-token] ok", None]
    assert [r.t for r in once.select(RD.redact(once.t).alias("t")).collect()] == [r.t for r in once.collect()]
