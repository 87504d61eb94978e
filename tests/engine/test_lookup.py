"""Substring search by trigrams and top-k search by bounds, against plain scans."""

import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import mining, search, substrings


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NESTED = ("BroadcastNestedLoopJoin", "CartesianProduct")


def test_contained(spark):
    r = random.Random(3)
    alphabet = "abcA é日_/.%"
    make = lambda low, high: "".join(r.choice(alphabet) for _ in range(r.randint(low, high)))
    texts = [make(0, 40) for _ in range(120)] + ["", "x", "xyz", None, "xyz"]
    needles = [make(0, 6) for _ in range(80)] + [t[2:7] for t in texts if t] + ["", "x", None, "never in there", "x"]
    told = substrings.contained(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(n,) for n in needles], "n string"), "n")
    expected = sorted((n, t) for n in {n for n in needles if n is not None} for t in {t for t in texts if t is not None} if n in t)
    assert sorted((x.needle, x.text) for x in told.collect()) == expected
    assert not any(n in plan(told) for n in NESTED)
    empty = spark.createDataFrame([], "n string")
    assert substrings.contained(empty, "n", empty, "n").count() == 0


def test_lookup_of_a_saved_index(spark, tmp_path):
    files = spark.createDataFrame([(k, f"Line {k} of {'GPL license' if k % 7 == 0 else 'text'} {k * k}") for k in range(300)] + [(900, None), (901, "")], "id long, content string")
    substrings.save_postings(files, "id", "content", str(tmp_path / "grams"))
    index = spark.read.parquet(str(tmp_path / "grams"))
    for pattern in ("LICENSE", "9 of", "zzz", "225", "ine"):
        ids = {x.id for x in substrings.lookup(index, pattern).collect()}
        hits = {x.id for x in files.where(F.contains(F.lower("content"), F.lit(pattern.lower()))).collect()}
        assert hits <= ids and len(ids) <= len(hits) + 12
    assert "PushedFilters: [In(piece" in plan(substrings.lookup(index, "license"))
    with pytest.raises(ValueError):
        substrings.lookup(index, "ab")


def test_gap_impact_and_scope_meet_by_pieces(spark):
    r = random.Random(8)
    words = ["get", "getUser", "User", "x", "a-b", "naïve", "$el", "b c", "run!", "serv"]
    exports = spark.createDataFrame([(f"src/{k}.ts", r.choice(words)) for k in range(40)] + [("src/z.ts", ""), ("src/z.ts", "default"), ("a/tests/q.ts", "get")], "file_path string, name string")
    files = [(f"a/tests/{k}.ts", " ".join(r.choice(["getUsers()", "my$el", "a-b", "q.x", "naïvety", "b c"]) for _ in range(k % 4))) for k in range(12)] + [("src/n.ts", "run! serv")]
    told = mining.test_gap(exports, spark.createDataFrame(files, "file_path string, content string"))
    held = " \n ".join(t for p, t in files if "/tests/" in p)
    assert sorted((x.file_path, x.name, x.tested) for x in told.collect()) == sorted((x.file_path, x.name, x.name in held) for x in exports.collect() if x.name not in ("", "default") and "/tests/" not in x.file_path)
    assert not any(n in plan(told) for n in NESTED)
    imports = spark.createDataFrame([(f"d/f{k}.ts", r.choice(["./f1", "lib/f2.ts", "", "react", "f", "../x/f12"]), r.choice(["src/server/a.ts", "src\\engines\\b.ts", "pkg"])) for k in range(60)], "file_path string, specifier string, target string")
    changed = spark.createDataFrame([("x/f1.ts",), ("lib/f2.ts",), ("none/zz.py",), ("d/f3.ts",)], "file_path string")
    told = mining.impact(changed, imports)
    rows = imports.collect()
    stem = lambda p: p.rpartition("/")[2].rpartition(".")[0]
    assert {x.file_path: x.downstream for x in told.collect()} == {c.file_path: sorted({i.file_path for i in rows if i.file_path != c.file_path and (stem(c.file_path) in i.specifier or i.specifier in c.file_path)}) for c in changed.collect()}
    assert not any(n in plan(told) for n in NESTED)
    scope = spark.createDataFrame([("d/f1", "src/engines", "error", "m"), ("d", "server", "warning", "n"), ("", "", "x", "y")], "from_part string, to_part string, severity string, message string")
    told = mining.scope_violations(imports, scope)
    expected = sorted((i.file_path, i.target, s.message) for i in rows for s in scope.collect() if s.from_part in i.file_path and s.to_part in i.target.replace("\\", "/"))
    assert sorted((x.file_path, x.imported, x.message) for x in told.collect()) == expected
    assert not any(n in plan(told) for n in NESTED)


@pytest.mark.parametrize("limit", [1, 3, 10])
def test_top_documents(spark, limit):
    """As all scores tell, ties included, from a part of the postings."""
    r = random.Random(limit)
    vocabulary = [f"w{k}" for k in range(300)]
    some = lambda n: " ".join(vocabulary[int(300 ** r.random()) - 1] for _ in range(n))  # noqa: E731  a few words are most of all
    docs = [(k, some(r.randint(0, 60))) for k in range(400)] + [(1000 + k, "w250 w251 w3") for k in range(5)] + [(2000, None)]
    queries = [(k, some(12)) for k in range(30)] + [(100, ""), (101, "unknown"), (102, "w250 w251"), (103, None)]
    told = [spark.createDataFrame(rows, "id long, text string") for rows in (docs, queries)]
    names = {"doc_id": "id", "doc_text": "text", "query_id": "id", "query_text": "text"}
    held = search.weighted_postings(*told, **names, blocks=16)
    best, read = search.top_documents(held, limit)
    whole = search.query_scores(*told, **names).collect()
    expected = []
    for q in {x.query_id for x in whole}:
        own = sorted((-round(x.score, 6), x.doc_id) for x in whole if x.query_id == q)
        expected += [(q, d) for s, d in own if s <= own[min(limit, len(own)) - 1][0]]
    assert sorted((x.query_id, x.doc_id) for x in best.collect()) == sorted(expected)
    scores = {(x.query_id, x.doc_id): x.score for x in whole}
    assert all(x.score == pytest.approx(scores[x.query_id, x.doc_id]) for x in best.collect())
    total = held.wanted.agg(F.sum("n_docs").alias("n")).first().n
    assert sum(x.n for x in read.collect()) < (0.6 if limit < 10 else 0.9) * total
