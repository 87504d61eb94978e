"""Text, path and chunk columns against small models in Python."""

import posixpath
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.functions import paths, text
from quarryline.operators import chunks, parse, search


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.o for r in rows.select("k", make(F.col("v")).alias("o")).orderBy("k").collect()]


def model_windows(n, size, overlap):
    if n <= size:
        return [(1, n)]
    out, start = [], 0
    while True:
        out.append((start + 1, min(start + size, n)))
        if start + size >= n:
            return out
        start += size - overlap


@pytest.mark.parametrize(("size", "overlap"), [(40, 8), (8, 2), (5, 0)])
def test_windows(spark, size, overlap):
    counts = [1, 2, 7, 8, 9, 39, 40, 41, 71, 72, 73, 104, 105, 200]
    files = spark.createDataFrame([(str(n), "\n".join(f"l{k}" for k in range(n))) for n in counts], "file_path string, content string")
    got = {}
    for r in chunks.windows(files, size, overlap).orderBy("chunk_seq").collect():
        got.setdefault(int(r.file_path), []).append((r.start_line, r.end_line))
        assert r.content == "\n".join(f"l{k}" for k in range(r.start_line - 1, r.end_line))
    assert got == {n: model_windows(n, size, overlap) for n in counts}


def test_lines(spark):
    files = spark.createDataFrame([("a", ""), ("b", "x"), ("c", "x\n"), ("d", "x\n\ny")], "file_path string, content string")
    assert {r.file_path: r.n for r in text.lines(files).groupBy("file_path").agg(F.max("n_lines").alias("n")).collect()} == {"a": 1, "b": 1, "c": 2, "d": 3}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abAB zé_./-!09\tThefor"), max_size=40), min_size=1, max_size=20))
def test_tokens(spark, values):
    assert column(spark, values, text.tokens) == [search.tokenize_query(v) for v in values]


def test_struct_hash(spark):
    same = ["function add(a, b) {\n  return a + b; // sum\n}", "function plus(x1, y) { return x1 + y; }", "function  f(p,q)"]
    one, two, three = column(spark, same, text.struct_hash)
    assert one != three
    assert column(spark, ["let x = 'a' + 12;", 'let yy = "bcd"  + 7.5;'], text.struct_hash)[0] == column(spark, ['let yy = "bcd"  + 7.5;'], text.struct_hash)[0]
    assert one == column(spark, ["function plus(x1, y) {\n return x1 + y; /* z */ }"], text.struct_hash)[0] or two


def test_small_columns(spark):
    assert column(spark, ["if (a&&b) {} else if (c) for(;;) case", "a || b", ""], text.complexity) == [5, 0, 0]
    assert column(spark, ["", "abc", "abcde"], text.token_estimate) == [0, 1, 2]
    assert column(spark, ["aé", ""], text.char_code_sum) == [97 + 233, 0]
    assert column(spark, [" \t x y\n ", "z"], text.trimmed) == ["x y", "z"]
    assert column(spark, ["key = 'v'", "none"], text.secret_label) == ["key = [REDACTED]", "[REDACTED]"]
    assert column(spark, ["ab", "abcdef"], lambda c: text.padded(c, 4)) == ["ab  ", "abcdef"]
    assert column(spark, [100, 34, 0], text.bar, "int") == ["█" * 10, "█" * 3 + "░" * 7, "░" * 10]


def test_paths(spark):
    values = ["a/./b//c", "a/../b", "/x/y/../z", "../a", "a/b/../../..", "a"]
    model = lambda p: posixpath.normpath(p.lstrip("/")) if posixpath.normpath(p.lstrip("/")) != "." else ""
    assert column(spark, values, paths.normalize_path) == [model(v) for v in values]
    assert column(spark, ["x/a.test.ts", "b", ".env"], paths.stem) == ["a.test", "b", ".env"]
    assert column(spark, ["x/y.TSX", "q.py", "noext", "a.b/c"], paths.language) == ["typescript", "python", None, None]
    assert column(spark, ["a/b/c"], paths.path_suffixes) == [["a/b/c", "b/c", "c"]]
    assert [tuple(r) for r in column(spark, ["https://H.com/p/q?x#y", "none", None], paths.url_parts)] == [("https", "H.com", "/p/q"), ("", "", ""), ("", "", "")]
    forms = ["https://host.com/o/r/blob/main/src/a.ts", "https://raw.host.com/o/r/dev/a.ts", "host.com/o/r", "https://host.com/o/r.git", "https://host.com/o/r/tree/b1"]
    assert [tuple(r) for r in column(spark, forms, paths.repository_parts)] == [("o", "r", "main", "src/a.ts"), ("o", "r", "dev", "a.ts"), ("o", "r", "main", ""), ("o", "r", "main", ""), ("o", "r", "b1", "")]


def test_param_count(spark):
    rows = [("f", "function", "function f(a, {b, c}, [d, e],) {", 3), ("g", "method", "g() {", 0), ("h", "fn", "x => x", 1), ("k", "class", "k(a, b)", 0), ("m", "function", "const m = (a, b, c, d, e) =>", 5), ("n.o", "function", "n.o(a)", 1)]
    df = spark.createDataFrame(rows, "name string, kind string, body string, n int")
    assert all(r.n == r.got for r in df.withColumn("got", parse.param_count(F.col("name"), F.col("kind"), F.col("body"))).collect())


def test_tags(spark):
    cases = {"class A": "class configuration", "async x": "async operations", "import x": "imports resolution", "x": None, "SELECT 1": "database queries"}
    rows = spark.createDataFrame([("a.ts", c) for c in cases], "p string, c string").select("c", chunks.intent_tags(F.col("p"), F.col("c")).alias("t"))
    for r in rows.collect():
        assert r.t[0] == chunks.BASE_TAG and (r.t[1] if len(r.t) > 1 else None) == cases[r.c]


def test_pattern_regex():
    assert re.search(search.pattern_regex("f($A, $...)"), "f(x, y, z)")
    assert not re.search(search.pattern_regex("f($A)"), "f(x y)")
    assert search.parse_query("find path:src/a lang:ts path:lib x:y:z").qualifiers == {"path": "lib", "lang": "ts", "x": "y"}
