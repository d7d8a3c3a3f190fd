"""Python texts are parsed some statements at a time, as if at once."""

import ast
import json.decoder
import textwrap
import tracemalloc

from sievelake.operators import code as C

ODD = [
    "", "x", "x = 1\r\ny = 2\r\n", "if a:\n    b\nelse:\n    c\nelse_x = 1\n", "try:\n    a\nexcept E:\n    b\nfinally:\n    c\n", "s = '''\ndef f():\n'''\ndef g(): pass\n",
    "x = (1,\ndef_ = 2)\n", "x = (1,\nb)\ny = 1\n", "x = \\\ny\nz = 1\n", "@d\ndef f():\n    return 1\nasync def g(): pass\n", "a = 1\n b = 2\n", "def f(:\nx = 1\n", "x = 1\ny = (\n", "a\0\nb = 1\n",
    "# c\n\nclass A:\n    def f(self):\n        pass\n# d\nclass B(A): pass", "\ufeffx = 1\ny = 2\n", "match x:\n    case 1:\n        pass\ny = 1\n", "x = 1\n\x0cy = 2\nz = 3\n", "x = '\ud800'\ny = 1\n",
]


def dump(text, size):
    try:
        return [(ast.dump(n), n.lineno + before, n.end_lineno + before) for tree, before in C.parts(text, size) for n in tree.body]
    except (SyntaxError, ValueError):
        return None


def test_parts_are_the_whole():
    files = [open(m.__file__, encoding="utf-8").read() for m in (ast, json.decoder, textwrap, tracemalloc)]
    cut = [f[: len(f) * k // 7] for f in files for k in range(1, 7)]
    for t in ODD + files + cut:
        assert dump(t, 1) == dump(t, 10**9)


def test_units_level_by_level_and_cut_bodies(monkeypatch):
    text = "class A:\n    def f(self):\n        A()\n        return 1\n\ndef g():\n    '''d'''\n    a = 1\n    b = 2\n    return f()\n\ndef _h(): pass\n"
    whole = C.importance(text, "g"), C.truncate(text)
    monkeypatch.setattr(C.parts, "__defaults__", (1,))
    assert (C.importance(text, "g"), C.truncate(text)) == whole
    assert [n for n, _, _ in whole[0]] == ["A", "g", "_h", "f"]
    assert whole[1][0].count("lines omitted") == 2


def test_memory_does_not_hold_a_tree_of_the_text():
    text = "import math\n\n" + "\n".join(f"def part_{i}(size):\n    # p\n    return size + {i}\n" for i in range(30_000))
    tracemalloc.start()
    assert len(C.importance(text, "size 4")) == 30_000
    assert C.truncate(text)[1] and C.language(text) == "python"
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_results_leave_python_in_parts(spark, monkeypatch):
    from sievelake.operators import reduce as R

    texts = [("a", "x" * 5_000_000), (None, None), ("b", ""), ("c", "y" * 5_000_000), ("d", "z")]
    df = spark.createDataFrame(texts, "k string, t string").coalesce(1)
    got = R.per_document(df, "k", "t", lambda t: (len(t or ""),), "n int")
    assert sorted(map(str, got.collect())) == sorted(f"Row(k={k!r}, n={len(t or '')})" for k, t in texts)
