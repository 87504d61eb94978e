"""Operators that split hot groups, with small blocks and ranges, against plain Python."""

import collections
import itertools
import random


from quarryline.operators import graph, mining
from quarryline.sources import store


def test_cochange_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mining, "BLOCK", 7)
    rng = random.Random(1)
    held = {(c, f"f{rng.randrange(60)}") for c, n in (("a", 80), ("b", 30), ("c", 9), ("d", 1)) for _ in range(n)}
    commits = spark.createDataFrame(sorted(held) + sorted(held)[:5], "commit_id string, file_path string")
    want, n = collections.Counter(), collections.Counter(f for _, f in held)
    for c in "abcd":
        want.update(itertools.permutations([f for k, f in held if k == c], 2))
    got = {(r.file_a, r.file_b): (r.cochange_count, r.ratio) for r in mining.cochange(commits).collect()}
    assert got == {(a, b): (k, int(100 * k / (n[a] + n[b] - k) + 0.5)) for (a, b), k in want.items()}
    assert mining.cochange(commits.limit(0)).count() == 0


def test_sliding_clones_in_ranges(spark):
    licence = "\n".join(f"line {k} of a licence that stands at the head of every file" for k in range(8))
    texts = {f"{k:03}.ts": (f"own {k}\n" if k % 3 else "") + licence + f"\nrest {k}" for k in range(120)} | {"x.ts": "", "y.ts": None}
    got = {r.file_path: (r.line_no, r.other_file, r.other_line) for r in mining.sliding_clones(spark.createDataFrame(list(texts.items()), "file_path string, content string")).collect()}
    assert got == {f"{k:03}.ts": (2 if k % 3 else 1, f"{k - 1:03}.ts", 2 if (k - 1) % 3 else 1) for k in range(1, 120)}


def test_names_within_words(spark):
    tests = [("x.test.ts", "describe(loadUserProfiles) über-größe a.b c"), ("y.spec.ts", ""), ("z.test.ts", None), ("src/q.ts", "neverTested")]
    names = ["describe", "loadUser", "loadUserP", "UserProfiles", "oadUserProfilesX", "serProfi", "größ", "über-g", "a.b", "c", "neverTested", "z", "default", "", None, "loadUserprofiles"]
    got = {r.name: r.tested for r in mining.test_gap(spark.createDataFrame([("s.ts", n) for n in names], "file_path string, name string"), spark.createDataFrame(tests, "file_path string, content string")).collect()}
    text = tests[0][1]
    assert got == {n: n in text for n in names if n not in ("default", "", None)}
    short = spark.createDataFrame([("s.ts", "desc")], "file_path string, name string")
    assert mining.test_gap(short, spark.createDataFrame(tests, "file_path string, content string")).first().tested


def test_numbered(spark):
    rows = [(k * 7919 % 500,) for k in range(500)]
    got = store.numbered(spark.createDataFrame(rows, "k long"), "n", "k")
    assert got.columns == ["k", "n"] and got.where("n <> k").count() == 0 and got.count() == 500
    assert store.numbered(got.limit(0).select("k"), "n", "k").count() == 0


def test_communities_settle(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(70)] + [(100 + k, 101 + k) for k in range(9)]
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    held = spark.createDataFrame(edges, "src long, dst long")
    for rounds in (0, 2):
        label = {r.id: r.community for r in graph.communities(held, rounds).collect()}
        assert set(label) == set(near)
        for v, around in near.items():
            votes = collections.Counter([label[u] for u in around] + [label[v]])
            assert label[v] == min(x for x, n in votes.items() if n == max(votes.values()))
