"""Git history in ranges, and rules of users as a table function."""

import subprocess
from collections import Counter

import pytest

from quarryline.operators import mining, parse, rules, user_rules
from quarryline.sources import files as sources
from quarryline.sources import history


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    git = lambda *args: subprocess.run(["git", "-C", str(root), "-c", "user.name=Ann Lee", "-c", "user.email=a@x.org", "-c", "init.defaultBranch=main", *args], check=True, capture_output=True)
    git("init")
    expected = []
    for k in range(11):
        names = [f"f{k % 3}.ts", "naïve file.ts", *([f"d/g{k}.py"] if k % 4 == 0 else [])]
        for n in names:
            (root / n).parent.mkdir(exist_ok=True)
            (root / n).write_text(f"{k}\n")
        if k == 5:
            git("commit", "--allow-empty", "-m", "empty")
        git("add", "-A")
        git("commit", "-m", f"c{k}")
        expected.append(sorted(names))
    return root, expected


def test_history_in_ranges(spark, repository):
    root, expected = repository
    told = history.git_history(spark, str(root), commits=2)
    assert told.rdd.getNumPartitions() == 6  # twelve commits, one of them empty
    held = told.collect()
    by = {}
    for r in held:
        by.setdefault(r.position, (r.commit_id, []))[1].append((r.file_seq, r.file_path))
    assert [sorted(n for _, n in by[p][1]) for p in sorted(by, reverse=True)] == expected
    assert {r.author for r in held} == {"Ann Lee"} and all(r.authored is not None for r in held) and all([s for s, _ in sorted(f)] == list(range(len(f))) for _, f in by.values())
    hashes = subprocess.run(["git", "-C", str(root), "log", "--format=%H"], capture_output=True, text=True).stdout.split()
    assert all(hashes[p] == c for p, (c, _) in by.items())
    whole = history.git_history(spark, str(root))
    assert whole.rdd.getNumPartitions() == 1 and sorted(map(tuple, whole.collect())) == sorted(map(tuple, held))
    parsed = parse.commit_log(sources.git_log(spark, str(root)))
    assert sorted(map(tuple, parsed.collect())) == sorted((r.commit_id, r.file_path) for r in held)
    counts = {r.file_path: r.commits_count for r in mining.commit_counts(told.select("commit_id", "file_path")).collect()}
    assert counts == Counter(n for names in expected for n in names)


def test_no_history(spark, tmp_path):
    assert history.git_history(spark, str(tmp_path)).count() == 0 and sources.git_log(spark, str(tmp_path)).count() == 0


CODE = "async function f() {}\nif (a) { for (b) while (c) }\nconst fooBar_baz = eval(1);\nlet A_B = 1\n" + "import x\n" * 16 + "\n" * 500


def test_rules_both_ways(spark):
    held = [("a.ts", CODE), ("b.ts", "/** x */\nasync () => {}\nawait x // eval(\n"), ("c.js", "eval(1) // safe-eval\neval(2)"), ("d.ts", ""), ("e.ts", "\n" * 499), ("f.js", "const naïve_Name = 1; let x = 1, y_Z = 2")]
    files = spark.createDataFrame(held, "file_path string, content string")
    columns = ["rule", "category", "file_path", "line", "description"]
    as_columns = sorted(map(tuple, rules.run_rules(files).select(*columns).collect()))
    assert sorted(map(tuple, user_rules.run_file_rules(files).select(*columns).collect())) == as_columns and len(as_columns) > 8
    user_rules.register(spark)
    told = spark.sql("SELECT i.rule, i.category, f.file_path, i.line, i.description FROM {files} f, LATERAL code_issues(f.file_path, f.content) i", files=files)
    assert sorted(map(tuple, told.collect())) == as_columns


def test_a_rule_of_a_user(spark):
    mine = user_rules.FileRule("todo", "Left to do", "Notes", lambda path, content: [(k, line.strip()) for k, line in enumerate(content.split("\n"), 1) if "TODO" in line])
    files = spark.createDataFrame([("a.py", "x\n # TODO one\n# TODO two"), ("b.py", None), ("c.py", "")], "file_path string, content string")
    assert sorted((r.file_path, r.line, r.description) for r in user_rules.run_file_rules(files, [mine]).collect()) == [("a.py", 2, "# TODO one"), ("a.py", 3, "# TODO two")]
    user_rules.register(spark, [mine], "my_rules")
    assert spark.sql("SELECT count(*) AS n FROM {f} f, LATERAL my_rules(f.file_path, f.content)", f=files).first().n == 2
