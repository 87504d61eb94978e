"""Graph operators against plain Python on random graphs."""

import itertools
import random
import time
from collections import Counter, defaultdict

import pytest

from quarryline.operators import graph


def some_graph(seed, n=12, m=22):
    r = random.Random(seed)
    return sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def reach(edges, start):
    seen, work = {start}, [start]
    while work:
        at = work.pop()
        for a, b in edges:
            if a == at and b not in seen:
                seen.add(b)
                work.append(b)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_cycles(spark, seed):
    edges = some_graph(seed)
    df = frame(spark, edges)
    nodes = {x for e in edges for x in e}
    to = {x: reach(edges, x) for x in nodes}
    expected = {x: min(y for y in nodes if y in to[x] and x in to[y]) for x in nodes}
    assert {r.id: r.component for r in graph.strong_components(df).collect()} == expected
    assert graph.has_cycle(df).first()[0] == any(a in to[b] for a, b in edges)
    have = set(edges)
    simple = set()
    for k in (1, 2, 3, 4):
        for p in itertools.permutations(sorted(nodes), k):
            if p[0] == min(p) and all((a, b) in have for a, b in zip(p, (*p[1:], p[0]), strict=True)):
                simple.add((*p, p[0]))
    got = [tuple(r.cycle) for r in graph.cycles(df, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == simple


def test_paths(spark):
    edges = some_graph(5)
    df = frame(spark, edges)
    nodes = sorted({x for e in edges for x in e})
    start = nodes[0]
    assert {r.id for r in graph.reachable(df, spark.createDataFrame([(start,)], "id long")).collect()} == reach(edges, start)
    for target in nodes[1:4]:
        path = [r.id for r in graph.shortest_path(df, start, target).orderBy("step").collect()]
        if target not in reach(edges, start):
            assert path == []
            continue
        best = min((p for k in range(len(nodes)) for p in itertools.permutations([n for n in nodes if n not in (start, target)], k) if all(e in set(edges) for e in zip((start, *p), (*p, target), strict=True))), key=lambda p: (len(p), p)) if len(path) <= 5 else None
        assert path[0] == start and path[-1] == target and all(e in set(edges) for e in zip(path, path[1:], strict=False))
        assert best is None or tuple(path[1:-1]) == best


def test_walk(spark):
    walk = graph.bounded_walk(frame(spark, [(1, 2), (2, 1), (2, 3), (1, 3)]), spark.createDataFrame([(1,)], "id long"), 3).orderBy("path").collect()
    assert [(list(r.path), r.is_cycle) for r in walk] == [([1], False), ([1, 2], False), ([1, 2, 1], True), ([1, 2, 3], False), ([1, 3], False)]


def test_communities(spark):
    ring = lambda k: [(a, b) for a in range(k, k + 4) for b in range(a + 1, k + 4)]
    df = frame(spark, ring(0) + ring(10) + [(0, 10)])
    parts = graph.communities(df)
    labels = {r.id: r.community for r in parts.collect()}
    assert len({labels[k] for k in range(4)}) == 1 and len({labels[k] for k in range(10, 14)}) == 1
    assert graph.modularity(df, parts).first()[0] >= 0


def partition_value(edges, label):
    links = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    m = len(links)
    inside = sum(label[a] == label[b] for a, b in links) / m
    degree = {}
    for a, b in links:
        degree[label[a]] = degree.get(label[a], 0) + 1
        degree[label[b]] = degree.get(label[b], 0) + 1
    return inside - sum((d / (2 * m)) ** 2 for d in degree.values())


@pytest.mark.parametrize("seed", [3])
def test_louvain(spark, seed):
    """Modularity is no lower than that of label propagation or of one community for each node, and near the best of many partitions."""
    r = random.Random(seed)
    group = {x: x // 8 for x in range(24)}
    edges = [(a, b) for a in range(24) for b in range(24) if a != b and r.random() < (0.5 if group[a] == group[b] else 0.04)]
    df = frame(spark, edges + edges[:5] + [(0, 0)])
    parts = graph.louvain(df)
    label = {row.id: row.community for row in parts.collect()}
    assert set(label) == {x for e in edges for x in e} and all(label[c] == c and c == min(x for x in label if label[x] == c) for c in label.values())
    value = partition_value(edges, label)
    assert graph.modularity(df, parts).first()[0] == pytest.approx(value)
    spread = {row.id: row.community for row in graph.communities(df).collect()}
    assert value >= partition_value(edges, spread) - 1e-9 and value >= partition_value(edges, group) - 0.02


def test_louvain_cases(spark):
    ring = [(10 * k + a, 10 * k + b) for k in range(6) for a in range(5) for b in range(a + 1, 5)] + [(10 * k, 10 * ((k + 1) % 6) + 1) for k in range(6)]
    assert {r.id: r.community for r in graph.louvain(frame(spark, ring)).collect()} == {10 * k + a: 10 * k for k in range(6) for a in range(5)}
    assert graph.louvain(frame(spark, [(1, 1)])).count() == 0 and graph.louvain(frame(spark, [])).count() == 0
    star = {r.community for r in graph.louvain(frame(spark, [(0, k) for k in range(1, 30)])).collect()}
    assert star == {0}


def plain_louvain(edges):
    """The same greedy method on one machine, level by level."""
    links = Counter()
    for a, b in {(min(e), max(e)) for e in edges if e[0] != e[1]}:
        links[a, b] += 1
        links[b, a] += 1
    m2 = sum(links.values())
    member = {x: x for e in links for x in e}
    while True:
        near, k = defaultdict(dict), Counter()
        for (a, b), w in links.items():
            k[a] += w
            if a != b:
                near[a][b] = w
        c, total, changed = {x: x for x in k}, Counter(k), True
        while changed:
            changed = False
            for x in sorted(k):
                total[c[x]] -= k[x]
                votes = Counter({c[x]: 0})
                for y, w in near[x].items():
                    votes[c[y]] += w
                best = max(votes, key=lambda g: (votes[g] - k[x] * total[g] / m2, -g))
                if votes[best] - k[x] * total[best] / m2 > votes[c[x]] - k[x] * total[c[x]] / m2 + 1e-9:
                    c[x], changed = best, True
                total[c[x]] += k[x]
        if all(x == g for x, g in c.items()) or len(set(c.values())) == len(c):
            return member
        member = {x: c[g] for x, g in member.items()}
        new = Counter()
        for (a, b), w in links.items():
            new[c[a], c[b]] += w
        links = new


@pytest.mark.parametrize("block", [10**6, 3000])
def test_louvain_in_blocks(spark, block):
    """A graph with and without clear groups, in one block and in several, with a node of more links than a block has; not below label propagation, nor far from the method on one machine."""
    r = random.Random(7)
    edges = [(x, r.choice([y for y in range(x // 25 * 25, x // 25 * 25 + 25)])) for x in range(1500) for _ in range(4)] + [(r.randrange(1500), r.randrange(1500)) for _ in range(3000)] + [(5000, x) for x in range(0, 1500, 3)]
    began = time.perf_counter()
    label = {row.id: row.community for row in graph.louvain(frame(spark, edges), block=block).collect()}
    assert time.perf_counter() - began < 60
    value = partition_value(edges, label)
    assert value >= partition_value(edges, plain_louvain(edges)) - (0.01 if block > 10**5 else 0.05)
    assert value >= partition_value(edges, {row.id: row.community for row in graph.communities(frame(spark, edges)).collect()})
    assert set(label) == {x for e in edges for x in e} and all(label[g] == g and g == min(x for x in label if label[x] == g) for g in set(label.values()))


def test_map_nodes(spark):
    df = frame(spark, [(1, 2), (2, 3), (3, 4)])
    ids = graph.vertices(df)
    assert sorted(r.id for r in graph.map_nodes(df, ids, 1).collect()) == [1, 2] and graph.map_nodes(df, ids).count() == 4
    assert sorted(r.id for r in graph.out_neighbors(df, 2).collect()) == [3] and sorted(r.id for r in graph.in_neighbors(df, 2).collect()) == [1]
