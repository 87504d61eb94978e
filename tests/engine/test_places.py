"""Ranges and imports at sizes where each pair of rows can't be met."""

import random
import time
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from quarryline.operators import graph, link


def contained(points, ranges):
    return link.first_container(points, ranges, key="f", at="x", low="lo", high="hi", order=["seq"], keep=["name"], point_id=["id"])


def test_first_container_is_exact(spark):
    """Keys with few and with many ranges, negative, empty and null ones, against a plain loop."""
    r = random.Random(5)
    ranges = [(f, lo, lo + r.choice([-1, 0, 1, 7, 60, 500]), seq, f"{f}{seq}") for f, n in (("few", 9), ("many", 300)) for seq, lo in enumerate(r.randrange(-300, 300) for _ in range(n))]
    points = [(k, r.choice(["few", "many", "none", None]), r.choice([None, *range(-400, 400)])) for k in range(1500)]
    told = contained(spark.createDataFrame(points, "id int, f string, x int"), spark.createDataFrame(ranges + [("few", None, 3, -1, "no")], "f string, lo int, hi int, seq int, name string"))
    expected = {k: min(((seq, name) for g, lo, hi, seq, name in ranges if g == f and x is not None and lo <= x <= hi), default=(0, None))[1] for k, f, x in points}
    assert {row.id: row.name for row in told.collect()} == expected and sum(v is not None for v in expected.values()) > 300


def test_first_container_of_one_large_key(spark):
    """200 000 places and as many ranges of one key, all within a minute."""
    n = 200_000
    points = spark.range(n).select("id", F.lit("a").alias("f"), F.col("id").alias("x"))
    ranges = spark.range(n).select(F.lit("a").alias("f"), F.col("id").alias("lo"), (F.col("id") + 5).alias("hi"), (-F.col("id")).alias("seq"), F.col("id").alias("name"))
    began = time.perf_counter()
    assert contained(points, ranges).where("id = name").count() == n
    assert time.perf_counter() - began < 60


def test_calls_of_one_large_file(spark):
    """Targets, dead files and dead symbols where one file holds all of 60 000 symbols and as many calls, each within a minute."""
    n = 60_000
    symbols = spark.range(n).select(
        F.lit("a/main.ts").alias("file_path"), F.concat(F.lit("s"), "id").alias("name"), F.concat(F.lit("a/main.ts#s"), "id").alias("symbol_id"), F.lit(False).alias("is_exported"), F.col("id").alias("parse_seq"),
        F.col("id").alias("start_line"), (F.col("id") + 20_000).alias("end_line"), F.lit("function").alias("kind"),
    )
    calls = spark.range(n).select(F.lit("a/main.ts").alias("file_path"), F.col("id").alias("parse_seq"), F.concat(F.lit("x.s"), (F.col("id") + 1) % (n + 1)).alias("callee"), F.col("id").alias("line"))
    imports = spark.createDataFrame([("a/main.ts", "b.ts", True, ["*"])], "file_path string, target string, resolved boolean, imported_names array<string>")
    files = spark.createDataFrame([("a/main.ts", "//"), ("b.ts", "//"), ("c.ts", "//")], "file_path string, content string")
    edges = link.call_edges(calls, symbols, imports)
    began = time.perf_counter()
    assert graph.call_graph(edges, symbols).where("dst <> 'a/main.ts#s0'").select("dst").distinct().count() == n
    assert time.perf_counter() - began < 60
    began = time.perf_counter()
    told = graph.dead_code(files, symbols, imports, edges.unionByName(link.import_edges(imports)))
    assert [r.file_path for r in told["dead_files"].collect()] == ["c.ts"] and told["dead_functions"].count() == 0
    assert time.perf_counter() - began < 60


def test_imports_are_resolved_once_a_folder(spark):
    """Many files of a folder: candidate paths are made for each folder and specifier, not for each file; odd rows keep what they had."""
    specs = ["./b", "../y/c.js", "y/c.js", "/src/y/e", "react", "."]
    orders = spark.range(100_000).select(F.concat(F.lit("src/x/o"), "id", F.lit(".ts")).alias("file_path"))
    imports = orders.select("file_path", F.explode(F.array(*[F.lit(s) for s in specs])).alias("specifier")).unionByName(spark.createDataFrame([("top.ts", "./b"), ("/r.ts", "./b"), (None, "./b"), (None, "y/c.js"), ("src/x/o1.ts", None)], "file_path string, specifier string"))
    files = spark.createDataFrame([("src/x/b.ts",), ("src/y/c.js",), ("src/y/e.ts",), ("b.ts",), ("src/x/index.ts",)], "file_path string").unionByName(orders)
    found = link.resolve_imports(imports, files)
    told = {tuple(r) for r in found.where("file_path IS NULL OR file_path NOT LIKE 'src/x/o%' OR file_path = 'src/x/o1.ts'").select("file_path", "specifier", "target", "resolved").collect()}
    one = [("./b", "src/x/b.ts"), ("../y/c.js", "src/y/c.js"), ("y/c.js", "src/y/c.js"), ("/src/y/e", "src/y/e.ts"), ("react", "react"), (".", "src/x/index.ts")]
    assert told == {("src/x/o1.ts", s, t, s != t) for s, t in one} | {("top.ts", "./b", "b.ts", True), ("/r.ts", "./b", "b.ts", True), (None, "./b", "./b", False), (None, "y/c.js", "y/c.js", False), ("src/x/o1.ts", None, None, False)}
    assert found.count() == 600_005
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_louvain_levels_in_one_task():
    """A graph that fits one block is done in its task: a ring of cliques in pairs, whose last level joins cliques."""
    links = [(10 * c + a, 10 * c + b) for c in range(30) for a in range(5) for b in range(a + 1, 5)] + [(10 * c, 10 * ((c + 1) % 30) + 1) for c in range(30)]
    ends = sorted(links + [(b, a) for a, b in links])
    k = Counter(a for a, _ in ends)
    rows = [{"id": a, "k": k[a], "c": a, "total": k[a], "dst": b, "w": 1, "dst_c": b, "dst_total": k[b]} for a, b in ends]
    told = graph._moved(pa.Table.from_pylist(rows), len(links), True).to_pylist()
    label = {r["id"]: r["c"] for r in told}
    assert set(label) == set(k) and all(label[10 * c + a] == label[10 * c] for c in range(30) for a in range(5)) and len(set(label.values())) < 30
