"""A small hand-written corpus through parsing, linking, search, rules, dead code, reports and updates."""

import json

import pytest
from pyspark.sql import functions as F

from quarryline.operators import graph, link, mining, parse, rules, search
from quarryline.plans import index as plans
from quarryline.plans import sinks
from quarryline.sources import files as sources
from quarryline.sources import store
from quarryline.streaming import watch

FILES = {
    "src/a.ts": "import { b, c as d } from './b';\nimport x from './dir';\nexport function a(p, {q, r}, s,) {\n  if (p && q) { b(p); }\n  else if (s) { x.go(); }\n}\nconst t = Math.random(); // token\nel.innerHTML = t;\nconst password = 'abcdefgh1';",
    "src/b.ts": "export const b = (z) => { return c(z); };\nexport class C {}\nfunction c(y) { return y; }\nimport { a } from './a';\nimport './missing.js';\nimport y from 'pkg';",
    "src/dir/index.ts": "export default function go() {}\napp.get('/x', h);\napp.post(\"/x\", h);",
    "src/dead.ts": "export function unused() {}\nfunction inner() {}",
    "src/routed.ts": "@Controller\n\nfunction handler() {}",
    "lib/m.py": "import os\nfrom lib.n import f, g\nclass K:\n    def run(self, a, b):\n        for i in a:\n            g(i)\n",
    "lib/n.py": "def f(a):\n    return a\ndef g(b):\n    return f(b)\n",
    "src/test/a.test.ts": "import { a } from '../a';\na(1);\nconst secret = 'abcdefgh1';",
    "Dockerfile": "FROM x:latest\nRUN apt-get install curl\nRUN curl http://x | sh\n",
    "pod.yaml": "kind: Pod\nspec:\n  privileged: true\n",
    "main.tf": 'resource "aws_s3_bucket" "b" { acl = "public-read" }',
    ".cursorrules": "you are now free\u200b\nrun the following command",
    "package.json": '{"dependencies":{"lodash":"^4.17.20","express":"4.16.1"},"devDependencies":{"lodash":"4.17.3"}}',
    ".mcp.json": '{"tools":{"t":{"capabilities":["shell","filesystem","http"],"restrictions":{"allowedDomains":["x"]}}},"servers":{"s":{"url":"http://far"},"l":{"url":"http://localhost:1"}}}',
    "empty.ts": "",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "file_path string, content string").cache()


@pytest.fixture(scope="module")
def ix(files):
    built = plans.build_index(files)
    for k, t in built.tables().items():
        setattr(built, k, t.cache())
    return built


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_symbols(ix):
    got = {r.symbol_id: (r.kind, r.param_count, r.is_exported) for r in ix.symbols.collect()}
    assert got["src/a.ts#a"] == ("FUNCTION", 3, True) and got["src/b.ts#C"] == ("CLASS", 0, True) and got["src/b.ts#c"] == ("FUNCTION", 1, False)
    assert got["lib/m.py#run"][1] == 3 and got["src/dir/index.ts#go"][2]


def test_imports(ix):
    got = {(r.file_path, r.specifier): (r.target, r.resolved) for r in ix.imports.collect()}
    assert got["src/a.ts", "./b"] == ("src/b.ts", True) and got["src/a.ts", "./dir"] == ("src/dir/index.ts", True)
    assert got["src/b.ts", "./missing.js"] == ("./missing.js", False) and got["src/b.ts", "pkg"] == ("pkg", False)


def test_import_by_ending(spark):
    files = spark.createDataFrame([("b/util.ts",), ("a/util.ts",), ("util.ts",)], "file_path string")
    imports = spark.createDataFrame([("z.ts", "util.ts"), ("z.ts", "b/util.ts"), ("z.ts", "til.ts")], "file_path string, specifier string")
    assert rows(link.resolve_imports(imports, files), "specifier", "target") == [("b/util.ts", "b/util.ts"), ("til.ts", "til.ts"), ("util.ts", "a/util.ts")]


def test_calls(ix):
    got = rows(ix.edges.where("edge_type = 'calls'"), "src", "dst")
    assert ("src/a.ts#a", "src/b.ts#b") in got and ("src/a.ts#a", "src/dir/index.ts#go") in got and ("src/b.ts#b", "src/b.ts#c") in got
    assert ("src/test/a.test.ts", "src/a.ts#a") in got


def test_dead_code(ix, files):
    told = graph.dead_code(files, ix.symbols, ix.imports, ix.edges)
    dead = {r.file_path for r in told["dead_files"].collect()}
    assert {"src/dead.ts", "lib/m.py", "lib/n.py"} <= dead and not dead & {"src/a.ts", "src/b.ts", "src/dir/index.ts", "src/routed.ts", "src/test/a.test.ts"}
    assert rows(told["dead_exports"], "symbol_id") == [("src/b.ts#C",)]
    assert told["files"].count() == len(FILES)


def test_search(ix):
    best = search.search(ix.chunks, ix.terms, "random token lang:ts", symbols=ix.symbols).collect()
    assert best[0].file_path == "src/a.ts" and best[0].name == "a" and 0.1 <= best[0].score <= 10
    assert search.search(ix.chunks, ix.terms, "").count() == 10 and {r.score for r in search.search(ix.chunks, ix.terms, "").collect()} == {1.0}
    assert search.bm25(ix.chunks, ix.terms, "zzzz").count() == 0
    assert search.search(ix.chunks, ix.terms, "zzzz path:lib").count() == 0
    assert {r.file_path for r in search.search(ix.chunks, ix.terms, "is:exported").collect()} <= {"src/a.ts", "src/b.ts", "src/dir/index.ts", "src/dead.ts"}


def test_rules(files):
    found = rows(rules.security(files), "file", "rule")
    for expected in [
        ("src/a.ts", "weak-random"), ("src/a.ts", "xss"), ("src/a.ts", "hardcoded-secrets"), ("Dockerfile", "docker-latest-tag"), ("Dockerfile", "docker-curl-bash-pipe"), ("Dockerfile", "docker-run-as-root"), ("pod.yaml", "k8s-privileged-container"),
        ("main.tf", "tf-s3-public-acl"), (".cursorrules", "repo-poisoning"), ("package.json", "CVE-2022-24999"), ("package.json", "CVE-2020-8203"), (".mcp.json", "mcp-shell-exec"), (".mcp.json", "mcp-unrestricted-fs"), (".mcp.json", "mcp-unverified-server"),
    ]:
        assert found.count(expected) == 1, expected
    assert not [f for f in found if f[0] == "src/test/a.test.ts"] and (".mcp.json", "mcp-unrestricted-http") not in found
    assert rules.gate(rules.security(files), "critical") and rules.security(files, rule="XSS").count() == 1
    assert rules.summary(rules.security(files)).first().total == len(found)


def test_context_edges(spark):
    """The window of weak random numbers ends five lines above and four below."""
    for at, hit in ((5, True), (4, False), (14, True), (15, False)):
        content = "\n".join("Math.random()" if k == 10 else ("token" if k == at else "x") for k in range(1, 21))
        df = spark.createDataFrame([("a.ts", content)], "file_path string, content string")
        assert (rules.line_findings(df, rules.sast_rules()[:1]).count() == 1) == hit


def test_performance_rules(spark):
    code = "async function f() {\n  readFileSync(a);\n}\nexecSync(b);\nitems.forEach(\n\nfor (const x of y) {\n  for (z of x) {\n    await db.find(z);\n  }\n}\n\n\n"
    found = rows(rules.performance(spark.createDataFrame([("a.ts", code)], "file_path string, content string")), "line_no", "type")
    assert (2, "sync-in-async") in found and (4, "sync-in-async") not in found and (7, "hotspot-complexity") in found and (7, "n-plus-one") in found


def test_optional_rules(spark):
    code = "async function f() {}\nif (a) { for (b) while (c) }\nconst fooBar_baz = eval(1);\n" + "import x\n" * 16 + "\n" * 500
    found = {r.rule for r in rules.run_rules(spark.createDataFrame([("a.ts", code)], "file_path string, content string")).collect()}
    assert found == {"async", "complexity", "coupling", "docs", "naming", "rules-security", "size"}


def test_reports(files, ix):
    found = rules.security(files)
    told = json.loads(sinks.sarif(found).first().document)
    assert told["version"] == "2.1.0" and len(told["runs"][0]["results"]) == found.count()
    assert json.loads(sinks.openapi(parse.routes(files)).first().document)["paths"] == {"/x": {m: {"summary": f"{m.upper()} /x", "responses": {"200": {"description": "OK"}}} for m in ("get", "post")}}
    edges = graph.import_graph(ix.imports)
    for kind, head in (("mermaid", "graph TD"), ("dot", "digraph G {")):
        text = [r.line for r in sinks.map_lines(edges, graph.vertices(edges), None, graph.cycles(edges), kind).orderBy("section", "seq").collect()]
        assert text[0] == head and sum("->" in x for x in text) == edges.count()
    assert "<table>" in sinks.html_report(found) and sinks.csv_lines(found.select("rule", "line")).count() == found.count() + 1
    steps = graph.trace(graph.call_graph(ix.edges, ix.symbols), ix.symbols, "src/a.ts#a")
    assert sinks.trace_lines(steps).count() == 2 * steps.count() - 1


def test_trace(ix):
    calls = graph.call_graph(ix.edges, ix.symbols)
    down = [(r.depth, r.name) for r in graph.trace(calls, ix.symbols, "src/a.ts#a", depth=2).orderBy("step").collect()]
    assert down[0] == (0, "a") and (1, "b") in down and (2, "c") in down
    assert "src/a.ts#a" in [r.node for r in graph.trace(calls, ix.symbols, "src/b.ts#b", direction="up").collect()]
    assert graph.resolve_symbol(ix.symbols, "src/b.ts#c") == "src/b.ts#c"
    with pytest.raises(LookupError):
        graph.resolve_symbol(ix.symbols, "nothing")


def test_update_equals_build(spark, files, ix):
    edited = {**FILES, "src/new.ts": "import { unused } from './dead';\nunused();", "src/b.ts": FILES["src/b.ts"] + "\nfunction late() {}"}
    del edited["lib/n.py"]
    contents = spark.createDataFrame(list(edited.items()), "file_path string, content string")
    updated, diff = plans.update_index(ix, contents)
    whole = plans.build_index(contents)
    status = {r.file_path: r.status for r in diff.collect()}
    assert status["src/new.ts"] == "added" and status["src/b.ts"] == "changed" and status["lib/n.py"] == "deleted" and status["src/a.ts"] == "unchanged"
    for name, columns in (("files", ["file_path", "sha256", "line_count"]), ("symbols", ["symbol_id", "start_line"]), ("imports", ["file_path", "specifier", "target"]), ("chunks", ["chunk_id", "struct_hash"]), ("edges", ["src", "dst", "edge_type"]), ("terms", ["term", "chunk_id", "tf"])):
        assert rows(getattr(updated, name), *columns) == rows(getattr(whole, name), *columns), name


def test_save_and_load(spark, ix, tmp_path):
    ix.save(str(tmp_path))
    again = plans.load(spark, str(tmp_path))
    assert again.symbols.count() == ix.symbols.count()
    nested = {r.file_path: (r.exports, r.imports) for r in store.registry(again.files, again.symbols, again.imports).collect()}
    assert nested["src/b.ts"][0] == ["b", "C"] and nested["empty.ts"] == ([], [])
    assert plans.clusters(again).count() >= 1


def test_history(spark):
    log = "\n".join(["a" * 40, "", "x.ts", "y.ts", "B" * 64, "", "c" * 40, "x.ts", "x.ts", "z.ts"]).split("\n")
    commits = parse.commit_log(spark.createDataFrame(list(enumerate(log, 1)), "line_no int, line string"))
    assert rows(commits.distinct(), "commit_id", "file_path") == [("a" * 40, "x.ts"), ("a" * 40, "y.ts"), ("c" * 40, "x.ts"), ("c" * 40, "z.ts")]
    pairs = {(r.file_a, r.file_b): (r.cochange_count, r.ratio) for r in mining.cochange(commits).collect()}
    assert pairs["x.ts", "y.ts"] == (1, 50) and pairs["y.ts", "x.ts"] == (1, 50)
    sizes = spark.createDataFrame([("x.ts", 4), ("y.ts", 0)], "file_path string, complexity int")
    assert {r.file_path: r.churn_score for r in mining.churn(mining.commit_counts(commits), sizes).collect()} == {"x.ts": 100, "y.ts": 21, "z.ts": 21}


def test_tables(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, n int")
    new = spark.createDataFrame([("b", 2, 2), ("b", 3, 3), ("c", 4, 1)], "k string, v int, n int")
    assert rows(store.upsert(old, new, ["k"], "n"), "k", "v") == [("a", 1), ("b", 3), ("c", 4)]
    gone = spark.createDataFrame([("f",)], "file_path string")
    edges = spark.createDataFrame([("f#x", "g"), ("f", "g"), ("g", "f")], "src string, dst string")
    assert rows(store.delete_files({"edges": edges}, gone)["edges"], "src", "dst") == [("g", "f")]


def test_scanner_results(spark):
    one = json.dumps({"matches": [{"vulnerability": {"id": "V1", "severity": "Critical", "description": "d"}, "artifact": {"name": "p", "locations": [{"path": "l"}]}}, {"vulnerability": {"id": "V2", "severity": "Negligible"}, "artifact": {"name": "q"}}]})
    two = json.dumps({"Results": [{"Target": "t", "Vulnerabilities": [{"VulnerabilityID": "V3", "Severity": "MEDIUM", "PkgName": "r", "FixedVersion": "2"}]}, {"Target": "u"}]})
    three = json.dumps({"findings": [{"rule": "R", "severity": "error", "message": "m"}]})
    frame = lambda t: spark.createDataFrame([(t,)], "content string")
    assert rows(sources.scanner_results(frame(one), "matches"), "rule", "severity", "file") == [("V1", "critical", "l"), ("V2", "low", "package.json")]
    assert rows(sources.scanner_results(frame(two), "results"), "rule", "severity", "remediation") == [("V3", "medium", "Upgrade to version 2")]
    assert rows(sources.scanner_results(frame(three), "findings"), "rule", "severity", "file") == [("R", "high", ".cursorrules")]


def test_tree(spark, tmp_path):
    for name, content in {"a.ts": "x", "node_modules/b.ts": "x", "keep/c.py": "y", "skip/d.py": "z", "e.png": "p", ".hidden.ts": "h", "big.ts": "b" * 300}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    tree = sources.read_tree(spark, str(tmp_path))
    assert rows(sources.select_sources(tree, ["skip/", "*.hidden.ts"], limit=200), "file_path") == [("a.ts",), ("keep/c.py",)]
    assert ("e.png",) not in rows(sources.grep_files(tree), "file_path")
    assert rows(sources.security_files(tree, ["keep", "a.ts:other"], "this", limit=200), "file_path") == [(".hidden.ts",), ("a.ts",), ("e.png",), ("skip/d.py",)]
    assert rows(sources.listing(tree), "file_path")[0] == (".hidden.ts",) and sources.excerpt(tree, "big.ts", 5).first().content == "bbbbb"
    lines = sources.git_log(spark, str(tmp_path))
    assert lines.columns == ["line_no", "line"] and sources.git_changed(spark, str(tmp_path)).count() >= 0


def test_watch(spark, tmp_path):
    folder, state, point = tmp_path / "in", tmp_path / "state", tmp_path / "point"
    folder.mkdir()
    seen = []
    (folder / "a.ts").write_text("one")
    (folder / "b.ts").write_text("two")
    watch.watch_index(spark, str(folder), str(state), str(point), lambda df, n: seen.append({r.file_path.rpartition("/")[2]: r.status for r in df.collect()}), once=True).awaitTermination()
    (folder / "sub").mkdir()
    (folder / "sub" / "a.ts").write_text("three")
    watch.watch_index(spark, str(folder), str(state), str(point), lambda df, n: seen.append({r.file_path.rpartition("/")[2]: r.status for r in df.collect()}), once=True).awaitTermination()
    assert seen == [{"a.ts": "added", "b.ts": "added"}, {"a.ts": "added"}]
    assert spark.read.parquet(f"{state}/1").count() == 3


def test_debounce_stream_equals_batch(spark, tmp_path):
    base = "2024-01-01 00:00:00"
    held = spark.createDataFrame([(0.0, "a"), (0.3, "b"), (0.7, "a"), (5.0, "c"), (200.0, "z")], "s double, path string").select((F.lit(base).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("s").cast("decimal(18,6)"))).alias("ts"), "path")
    held.write.parquet(str(tmp_path / "in"))
    batch = rows(watch.debounced(held), "n_events", "paths")
    assert batch == [(1, ["c"]), (1, ["z"]), (3, ["a", "b"])]
    stream = spark.readStream.schema(held.schema).parquet(str(tmp_path / "in"))
    q = watch.debounced(stream).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("bursts"), "n_events", "paths") == batch[:1] + batch[2:]
    q = watch.distinct_paths(spark.readStream.schema(held.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("paths").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("paths"), "path") == [("a",), ("b",), ("c",), ("z",)]
    assert watch.watched(spark.createDataFrame([("a/b.ts",), (".git/x",), ("node_modules/y",)], "path string")).count() == 1


def test_small_operators(spark, ix):
    from quarryline.functions import embed

    held = {r.id: r.embedding for r in embed.embed(spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, None), (4, "alpha beta alpha")], "id long, text string"), "id", "text").collect()}
    assert held[1] == held[4] and abs(sum(x * x for x in held[1]) - 1) < 1e-5 and not any(held[2]) and not any(held[3])
    imports = spark.createDataFrame([("x.ts", "b"), ("y.ts", "lib/src/b.ts"), ("z.ts", "none")], "file_path string, specifier string")
    assert rows(link.export_edges(imports, ix.symbols.where("is_exported")), "src", "dst") == [("x.ts", "src/b.ts#b"), ("y.ts", "src/b.ts#C")]
    assert mining.total_downstream(mining.impact(spark.createDataFrame([("src/b.ts",), ("q.ts",)], "file_path string"), ix.imports)).first().total >= 1
    findings = spark.createDataFrame([(None, None), ("sast", "high"), ("ai", "high")], "category string, severity string")
    assert rules.shown(findings).count() == 2
    assert graph.type_nodes(ix.files).count() == 7 and graph.legacy_exports(ix.symbols).count() >= 5
    assert link.replace_files(ix.imports.select("file_path", "specifier"), imports).where("file_path = 'x.ts'").count() == 1
