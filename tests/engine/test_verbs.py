"""The verbs on the small corpus, and the command line."""

import pytest

from quarryline import __main__ as cli
from quarryline.plans import index as plans
from quarryline.plans import verbs
from tests.engine.test_corpus import FILES


@pytest.fixture(scope="module")
def ix(spark):
    files = spark.createDataFrame(list(FILES.items()), "file_path string, content string").cache()
    commits = spark.createDataFrame([("c1", "src/a.ts"), ("c1", "src/b.ts"), ("c2", "src/a.ts")], "commit_id string, file_path string")
    built = plans.build_index(files, commits)
    for k, t in built.tables().items():
        setattr(built, k, t.cache())
    return built


def test_verbs(ix, spark):
    issues, score = verbs.doctor(ix)
    kinds = {r.category for r in issues.collect()}
    assert {"circular-deps", "dead-export"} <= kinds and 10 <= score.first().score <= 100
    assert {r.severity for r in verbs.doctor(ix, severity="HIGH")[0].collect()} == {"high"}
    assert any("cycle" in r.line for r in verbs.code_map(ix).collect())
    assert verbs.hotspots(ix).first().file_path in ("src/a.ts", "src/b.ts") and [r.file_b for r in verbs.coupled(ix, "src/a.ts").collect()] == ["src/b.ts"]
    assert {r.package for r in verbs.deps(ix.contents).collect()} == {"lodash", "express"}
    assert verbs.api(ix.contents).count() == 2 and verbs.scope(ix).count() == 0 and verbs.benchmark(ix.contents).count() == 0
    gap, coverage = verbs.test_gap(ix)
    assert gap.where("name = 'a'").first().tested and coverage.first().total == gap.count()
    impact, findings = verbs.diff(ix, spark.createDataFrame([("src/a.ts",)], "file_path string"))
    assert impact.count() == 1 and findings.count() == 3
    assert verbs.stats(ix)["totals"].first().n_files == len(FILES)
    facts, chart = verbs.explain(ix)
    assert not facts.first().full_stack and chart.count() >= 0
    assert verbs.context(ix, "random token", budget=1000).count() >= 1 and verbs.grep(ix.contents, "MATH.random").count() == 1
    assert {k: t.count() > 0 for k, t in verbs.dead(ix).items()}["dead_files"]


def test_trace_intent(ix):
    assert verbs.trace_intent("flow from a to b") == {"from": "a", "to": "b"}
    assert verbs.trace_intent("who calls c") == {"symbol": "c", "direction": "up"}
    assert verbs.trace_intent("trace callees of f") == {"symbol": "f", "direction": "down"}
    assert [r.name for r in verbs.trace(ix, "flow from a to src/b.ts#c").orderBy("step").collect()] == ["a", "b", "c"]


def test_command_line(spark, tmp_path, capsys):
    for name, content in FILES.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(content)
    root, index = str(tmp_path / "tree"), str(tmp_path / "index")
    assert cli.main(["index", root, "--index", index]) == 0
    assert cli.main(["search", root, "random token", "--index", index]) == 0 and "src/a.ts" in capsys.readouterr().out
    assert cli.main(["security", root, "--fail-on", "critical", "--format", "sarif", "--output", str(tmp_path / "out")]) == 1
    assert spark.read.text(str(tmp_path / "out")).count() == 1
    assert cli.main(["stats", root, "--index", index]) == 0
