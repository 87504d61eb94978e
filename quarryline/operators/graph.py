"""Graphs as edge tables: neighbours, walks, reachability, paths, cycles, components, communities by votes and by modularity, dead code.

Loops work on frontiers, anti-joined with what was seen, and write each state as a table, so that a lost executor costs
one round and plans don't grow. Only row counts come to the driver.
"""

from __future__ import annotations

import collections
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import lines
from quarryline.sources.store import written

# Where dead-code analysis and maps begin.
ENTRY_FILE = r"(?:server\.ts|server\.js|server\.tsx|cli\.ts|main\.ts|main\.tsx|index\.ts|index\.tsx|app\.tsx|app\.ts|index\.html)$|/cli/|^src/cli|test|spec|__tests__|tests"
ROUTE_DECORATOR = r"(?i)@\w*(route|get|post|put|delete|patch|controller)"
MAP_ENTRIES = ("server.ts", "src/cli.ts", "src/main.tsx", "src/index.ts", "src/main.ts", "src/cli/index.ts")
#: A move must gain more than this, in links; less is rounding.
EPSILON = 1e-9
#: Ends of links that a block of local moves has, about.
BLOCK_LINKS = 1_000_000
FUNCTION_KINDS = ("function", "method", "fn", "async-function", "arrow", "class")


# Building -----------------------------------------------------------------------------------------------------------


def simple_digraph(edges: DataFrame, loops: bool = False) -> DataFrame:
    """``src, dst``, each once; loops only on demand."""
    held = edges.select("src", "dst").distinct()
    return held if loops else held.where("src <> dst")


def vertices(edges: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """``id``: all ends of edges, and the ids of ``own``."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return (ends.union(own.select("id")) if own is not None else ends).distinct()


def import_graph(imports: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Import edges from the imports, or from the edge table where there are none."""
    held = imports.where("target IS NOT NULL").select(F.col("file_path").alias("src"), F.col("target").alias("dst"))
    if edges is not None and held.isEmpty():
        held = edges.where("edge_type = 'imports'").select("src", "dst")
    return simple_digraph(held)


def self_imports(imports: DataFrame) -> DataFrame:
    return imports.where("file_path = target").select("file_path").distinct()


def call_graph(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call edges, with targets by symbol id where one is known; loops stay."""
    ids = symbols.select(F.col("symbol_id").alias("dst"), F.col("symbol_id").alias("_id"))
    return simple_digraph(edges.where("edge_type = 'calls'").join(ids, "dst", "left").select("src", F.coalesce("_id", "dst").alias("dst")), loops=True)


def out_neighbors(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("src") == node).select(F.col("dst").alias("id")).distinct()


def in_neighbors(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("dst") == node).select(F.col("src").alias("id")).distinct()


def in_degree(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, n`` for all ids, 0 without edges."""
    counts = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return ids.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def legacy_exports(symbols: DataFrame) -> DataFrame:
    """Each export as a node below its file."""
    return symbols.where("is_exported").select(F.col("file_path").alias("src"), F.col("symbol_id").alias("dst"), F.lit("exports").alias("edge_type"))


def type_nodes(files: DataFrame) -> DataFrame:
    """TypeScript files as nodes of a graph without edges."""
    return files.where(F.col("file_path").rlike(r"\.tsx?$")).select(F.col("file_path").alias("id"))


# Walks --------------------------------------------------------------------------------------------------------------


def bounded_walk(edges: DataFrame, start: DataFrame, depth: int = 3, direction: str = "down") -> DataFrame:
    """``root, path, node, depth, is_cycle``: all walks from the starts up to ``depth`` edges; a node that is its own ancestor ends its walk.

    One join for each level; siblings go in the order of their ids, so ordering by ``path`` is preorder.
    """
    held = edges.select("src", "dst").distinct()
    if direction == "up":
        held = held.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    level = start.select(F.col("id").alias("root"), F.array("id").alias("path"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit(False).alias("is_cycle"))
    told = level
    for k in range(1, (depth or 3) + 1):
        level = level.where("NOT is_cycle").join(held, F.col("node") == F.col("src")).select("root", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node"), F.lit(k).alias("depth"), F.array_contains("path", F.col("dst")).alias("is_cycle"))
        told = told.unionByName(level)
    return told


def distances(edges: DataFrame, start: DataFrame, most: int | None = None, until=None) -> DataFrame:
    """``id, distance`` of all nodes that the starts reach; stops at ``most`` edges, or when ``until`` is reached."""
    held = written(edges.select("src", "dst").distinct(), "edges")
    seen = written(start.select("id").distinct().withColumn("distance", F.lit(0)), "seen")
    frontier, k = seen.select("id"), 0
    while most is None or k < most:
        k += 1
        new = frontier.join(held, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        new = written(new.withColumn("distance", F.lit(k)), "frontier")
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new.select("id")
        if k % 10 == 0:
            seen = written(seen, "seen")
        if until is not None and not new.where(F.col("id") == until).isEmpty():
            break
    return seen


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``id`` of all nodes that the starts reach, themselves too."""
    return distances(edges, start).select("id")


def shortest_path(edges: DataFrame, source, target) -> DataFrame:
    """``step, id`` of a shortest path; of several the first in the order of ids. None without a path.

    Distances go forward to the target; then the nodes that lie on a shortest path are kept backwards, level by level, and
    the path takes the smallest successor at each level.
    """
    spark = edges.sparkSession
    one = lambda x: spark.range(1).select(F.lit(x).alias("id"))
    seen = written(distances(edges, one(source), until=target), "distances")
    end = seen.where(F.col("id") == target).select(F.max("distance").alias("d")).first()["d"]  # one number
    if end is None:
        return spark.createDataFrame([], f"step int, id {edges.schema['src'].dataType.simpleString()}")
    held = edges.select("src", "dst").distinct()
    levels = {end: one(target)}
    for k in range(end - 1, -1, -1):
        on = held.join(levels[k + 1].withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        levels[k] = written(on.join(seen.where(F.col("distance") == k), "id", "left_semi"), "level")
    told, at = one(source).select(F.lit(0).alias("step"), "id"), one(source)
    for k in range(1, end + 1):
        nxt = held.join(at.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).join(levels[k], "id", "left_semi")
        at = written(nxt.agg(F.min("id").alias("id")), "step")  # one row
        told = told.unionByName(at.select(F.lit(k).alias("step"), "id"))
    return told


# Cycles and components ----------------------------------------------------------------------------------------------


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges that remain when nodes without a way in or without a way out go, again and again. Empty if there is no cycle."""
    held = written(edges.select("src", "dst").distinct(), "core")
    n = held.count()
    while n:
        ins, outs = held.select(F.col("dst").alias("id")).distinct(), held.select(F.col("src").alias("id")).distinct()
        left = held.join(ins, F.col("src") == F.col("id"), "left_semi").join(outs, F.col("dst") == F.col("id"), "left_semi")
        left = written(left, "core")
        m = left.count()
        held = left
        if m == n:
            break
        n = m
    return held


def has_cycle(edges: DataFrame) -> DataFrame:
    """One row: whether there is a cycle, loops too."""
    return cyclic_core(edges).agg((F.count("*") > 0).alias("has_cycle"))


def cycles(edges: DataFrame, longest: int = 4) -> DataFrame:
    """``cycle``: all simple cycles of up to ``longest`` nodes, each once, from its smallest node on and back to it; loops are cycles of one.

    Walks start at every node and go on only over larger ones, so that no rotation of a cycle is made twice; only the
    cyclic core is walked.
    """
    core = cyclic_core(edges)
    told = core.where("src = dst").select(F.array("src", "dst").alias("cycle"))
    walk = core.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    for k in range(2, longest + 1):
        told = told.unionByName(walk.join(core, (F.col("at") == F.col("src")) & (F.col("dst") == F.col("path")[0])).select(F.concat("path", F.array("dst")).alias("cycle")))
        if k < longest:
            walk = walk.join(core, F.col("at") == F.col("src")).where((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
    return told


def cycle_edges(found: DataFrame) -> DataFrame:
    """``src, dst`` of consecutive nodes of cycles."""
    pairs = F.arrays_zip(F.expr("slice(cycle, 1, size(cycle) - 1)").alias("a"), F.expr("slice(cycle, 2, size(cycle) - 1)").alias("b"))
    return found.select(F.explode(pairs).alias("p")).select(F.col("p.a").alias("src"), F.col("p.b").alias("dst")).distinct()


def _least_label(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, label``: the least id that reaches each node."""
    labels = written(ids.withColumn("label", F.col("id")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("_l")), "src").groupBy("dst").agg(F.min("_l").alias("_l"))
        new = written(labels.join(near, F.col("id") == F.col("dst"), "left").select("id", F.least("label", "_l").alias("label"), F.col("label").alias("_before")), "labels")
        labels = new.select("id", "label")
        if new.where("label <> _before").isEmpty():
            return labels


def strong_components(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``id, component``: the least id of each strongly connected component.

    Rounds of forward and backward least labels: a node whose least ancestor has itself as its least ancestor, and which
    leads back to it, is in its component. Found components go and the rest is labelled again; nodes on no cycle are peeled
    off before each round, for they are components of their own.
    """
    ids = written((ids if ids is not None else vertices(edges)).select("id").distinct(), "scc-ids")
    left_edges = cyclic_core(simple_digraph(edges))
    left = written(vertices(left_edges), "scc-left")
    told = ids.join(left, "id", "left_anti").select("id", F.col("id").alias("component"))
    while not left.isEmpty():
        forward = _least_label(left_edges, left)
        same = written(
            left_edges.join(forward.select(F.col("id").alias("src"), F.col("label").alias("_a")), "src").join(forward.select(F.col("id").alias("dst"), F.col("label").alias("_b")), "dst").where("_a = _b").select("src", "dst"),
            "scc-same",
        )
        back = same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        hit = reachable(back, forward.where("id = label").select("id"))
        found = written(forward.join(hit, "id", "left_semi").select("id", F.col("label").alias("component")), "scc-found")
        rest = same.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti")
        left_edges = cyclic_core(rest)
        again = written(vertices(left_edges), "scc-left")
        single = left.join(found, "id", "left_anti").join(again, "id", "left_anti").select("id", F.col("id").alias("component"))
        told = told.unionByName(found).unionByName(single)
        left = again
    return told


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """``id, community``: label propagation on the undirected graph. Each round a node takes the most frequent label among its neighbours and itself, the least of several; labels are ids.

    Deterministic, and goes on until labels are settled. All nodes change at once for up to ``rounds`` rounds. If they still
    change then, they may swing, so that from then on only nodes change whose neighbours don't: of neighbours that want to, the
    one with the least hash in this round. Each such change adds links within communities, so there is an end.
    """
    plain = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    both = written(plain.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(plain.select("b", "a")), "undirected")
    labels = written(both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    for k in itertools.count():
        votes = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("id"), "label").unionByName(labels)
        counted = votes.groupBy("id", "label").agg(F.count("*").alias("n"))
        best = counted.groupBy("id").agg(F.max("n").alias("n"))
        new = counted.join(best, ["id", "n"]).groupBy("id").agg(F.min("label").alias("label"))
        told = written(new.join(labels.withColumnRenamed("label", "_before"), "id"), "labels")
        if k >= rounds:
            turn = F.struct(F.xxhash64("id", F.lit(k)).alias("h"), F.col("id").alias("i"))
            wish = told.where("label <> _before").select("id", turn.alias("_turn"))
            near = both.join(wish.select(F.col("id").alias("dst"), F.col("_turn").alias("_near")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("_near").alias("_near"))
            first = wish.join(near, "id", "left").where("_near IS NULL OR _turn < _near").select("id", F.lit(True).alias("_first"))
            labels = written(told.join(first, "id", "left").select("id", F.when(F.col("_first"), F.col("label")).otherwise(F.col("_before")).alias("label")), "labels")
        else:
            labels = told.select("id", "label")
        if told.where("label <> _before").isEmpty():
            break
    return labels.withColumnRenamed("label", "community")


def _placed(both: DataFrame, labels: DataFrame, m: int, wanted: DataFrame) -> DataFrame:
    """``id, c0, c1, gain`` of the nodes ``wanted``: their community, the one where they add most (the least of several) and what the move gains in links."""
    votes = both.join(labels.select(F.col("id").alias("dst"), "c"), "dst").select(F.col("src").alias("id"), "c", "w").unionByName(labels.join(wanted, "id", "left_semi").select("id", "c", F.lit(0).cast("long").alias("w")))
    summed = votes.groupBy("id", "c").agg(F.sum("w").alias("w"))
    totals = labels.groupBy("c").agg(F.sum("k").alias("total"))
    held = summed.join(labels.select("id", "k", F.col("c").alias("c0")), "id").join(totals, "c")
    own = F.col("c") == F.col("c0")
    value = F.col("w") - F.col("k") * (F.col("total") - F.when(own, F.col("k")).otherwise(0)) / F.lit(2.0 * m)
    held = held.withColumn("_v", value)
    only = lambda c: F.max(F.when(own, F.col(c)))
    best = F.min(F.struct((-F.col("_v")).alias("v"), F.col("c").alias("c")))
    told = held.groupBy("id").agg(F.first("c0").alias("c0"), best.alias("_b"), only("_v").alias("_stay"))
    return told.select("id", "c0", F.col("_b.c").alias("c1"), (-F.col("_b.v") - F.col("_stay")).alias("gain"))


def _settled(x: np.ndarray, at: np.ndarray, outside: np.ndarray, w: np.ndarray, k: np.ndarray, mine: np.ndarray, total: np.ndarray, m: int) -> np.ndarray:
    """The communities of a block's nodes after local moves: one node after the other goes to the neighbouring community that gains most (the least of several), until none gains. Rows are links, by node ``x``, to node ``at`` or, where that is -1, to a community ``outside``."""
    ends = np.append(np.searchsorted(x, np.arange(len(k))), len(x)).tolist()
    at, outside, w, k, mine, total = (v.tolist() for v in (at, outside, w, k, mine, total))
    waiting, queued = collections.deque(range(len(k))), [True] * len(k)
    while waiting:
        v = waiting.popleft()
        queued[v] = False
        near = {mine[v]: 0}
        for e in range(ends[v], ends[v + 1]):
            c = mine[at[e]] if at[e] >= 0 else outside[e]
            near[c] = near.get(c, 0) + w[e]
        own, share = mine[v], k[v] / (2.0 * m)
        total[own] -= k[v]
        stay = near[own] - share * total[own]
        value, c = max((n_links - share * total[c], -c) for c, n_links in near.items())
        if value > stay + EPSILON and -c != own:
            mine[v] = -c
            for e in range(ends[v], ends[v + 1]):
                if at[e] >= 0 and not queued[at[e]] and mine[at[e]] != -c:
                    queued[at[e]] = True
                    waiting.append(at[e])
        total[mine[v]] += k[v]
    return np.array(mine, np.int64)


def _in_levels(x: np.ndarray, at: np.ndarray, w: np.ndarray, k: np.ndarray, m: int) -> np.ndarray:
    """The communities of a whole graph that fits one block: local moves, then communities as nodes, until a level gains nothing."""
    member = np.arange(len(k))
    while True:
        mine = _settled(x, at, at, w, k, np.arange(len(k)), k, m)
        gain = w[mine[x] == mine[at]].sum() / (2.0 * m) - ((np.bincount(mine, k) ** 2).sum() - (k.astype(float) ** 2).sum()) / (4.0 * m * m)
        names, code = np.unique(mine, return_inverse=True)
        if gain <= 0 or len(names) == len(k):
            return member
        member, k = code[member], np.bincount(code, k).astype(np.int64)
        keys, inverse = np.unique(code[x] * len(names) + code[at], return_inverse=True)
        w = np.bincount(inverse, w).astype(np.int64)
        x, at = np.divmod(keys, len(names))
        x, at, w = x[x != at], at[x != at], w[x != at]


def _moved(rows: pa.Table, m: int, whole: bool) -> pa.Table:
    """``id, c`` of the nodes of a block after local moves, of a ``whole`` graph after all levels. What is outside the block stays where it is."""
    rows = rows.sort_by([("id", "ascending"), ("dst", "ascending")])
    take = lambda name: rows.column(name).to_numpy()
    ids, first, x = np.unique(take("id"), return_index=True, return_inverse=True)
    at = np.minimum(np.searchsorted(ids, take("dst")), len(ids) - 1)
    k = take("k")[first]
    if whole:
        told = _in_levels(x, at, take("w"), k, m)
        return pa.table({"id": ids, "c": ids[np.unique(told, return_index=True)[1]][told]})
    at = np.where(ids[at] == take("dst"), at, -1)
    names, place, code = np.unique(np.concatenate([take("c"), take("dst_c")]), return_index=True, return_inverse=True)
    total = np.concatenate([take("total"), take("dst_total")])[place]
    mine = _settled(x, at, code[rows.num_rows :], take("w"), k, code[first], total, m)
    return pa.table({"id": ids, "c": names[mine]})


def _block_of(c: Column, turn: int, n_blocks: int, halves: list[int] | None) -> Column:
    """The block of a community in a pass: by ranges of ids, which often keep neighbours together, then by ranges half a block further, then by hashes. ``halves`` cuts the ids into halves of blocks."""
    if halves is None or turn > 1:
        return F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(n_blocks))
    cuts = F.array(*[F.lit(h).cast("long") for h in halves[1 - turn :: 2]])
    return F.size(F.filter(cuts, lambda h: h <= c)).cast("long")


def _quality(both: DataFrame, labels: DataFrame, m: int) -> float:
    """The modularity of labels ``id, k, c`` of a graph whose links weigh ``m`` together, those within a node included in its ``k``."""
    of = lambda end, name: labels.select(F.col("id").alias(end), F.col("c").alias(name)).hint("shuffle_hash")
    near = both.where("src < dst").join(of("src", "_a"), "src").join(of("dst", "_b"), "dst")
    inner = 2 * (near.where("_a = _b").agg(F.sum("w")).first()[0] or 0)
    told = labels.groupBy("c").agg(F.sum("k").cast("double").alias("t"), F.sum("loops").alias("l")).agg(F.sum(F.pow("t", 2)).alias("t"), F.sum("l").alias("l")).first()
    return (inner + (told["l"] or 0)) / (2.0 * m) - (told["t"] or 0.0) / (4.0 * m * m)


def louvain(edges: DataFrame, least: float = 1e-4, block: int = BLOCK_LINKS) -> DataFrame:
    """``id, community``: greedy modularity in levels on the undirected simple graph of integer ids; a community is named by its least id.

    Nodes are dealt to blocks of about ``block`` ends of links by their community, so that a community moves together. In a pass each block settles its own nodes, one after the other, against what stands outside. Blocks that
    move at once can lose: a pass after which modularity has not grown by ``least`` is taken back and ends the level. Nodes
    with more than ``block`` links are in no block; the best of them (by gain) moves after each pass. Then communities become
    nodes, until a level changes nothing; a graph that fits one block goes through the levels that are left in its task. Loops
    and repeated links don't count; no link, no rows.
    """
    plain = edges.select(F.least("src", "dst").cast("long").alias("a"), F.greatest("src", "dst").cast("long").alias("b")).where("a <> b").distinct()
    one = F.lit(1).cast("long").alias("w")
    both = written(plain.select(F.col("a").alias("src"), F.col("b").alias("dst"), one).union(plain.select("b", "a", one)), "undirected")
    m = both.count() // 2
    labels = written(both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"), F.count("*").alias("n")).select("id", "k", F.col("id").alias("c"), F.lit(0).cast("long").alias("loops"), "n"), "labels")
    member = labels.select("id", F.col("id").alias("node"))
    while m:
        links = both.count()
        n_blocks = max(1, -(-links // block))
        whole = n_blocks == 1
        quality = None if whole else _quality(both, labels, m)
        halves = None if whole else both.select(F.percentile_approx("src", [k / (2 * n_blocks) for k in range(1, 2 * n_blocks)], 10_000)).first()[0]  # numbers of blocks
        for turn in itertools.count():
            state = labels.join(labels.groupBy("c").agg(F.sum("k").alias("total")), "c")
            ends = both.join(state.select(F.col("id").alias("dst"), F.col("c").alias("dst_c"), F.col("total").alias("dst_total")).hint("shuffle_hash"), "dst")
            held = state.where(F.col("n") <= block).select(F.col("id").alias("src"), "k", "c", "total", _block_of(F.col("c"), turn, n_blocks, halves).alias("block"))
            rows = ends.join(held.hint("shuffle_hash"), "src").select("block", F.col("src").alias("id"), "k", "c", "total", "dst", "w", "dst_c", "dst_total")
            moved = rows.groupBy("block").applyInArrow(lambda t: _moved(t, m, whole), "id long, c long")
            new = written(labels.withColumnRenamed("c", "_c").join(moved, "id", "left").select("id", "k", F.coalesce("c", "_c").alias("c"), "loops", "n"), "labels")
            if not whole and not (hubs := new.where(F.col("n") > block)).isEmpty():
                best = _placed(both.join(hubs.select(F.col("id").alias("src")), "src", "left_semi"), new, m, hubs.select("id")).where(f"c0 <> c1 AND gain > {EPSILON}").orderBy(F.desc("gain"), "id").limit(1)
                new = written(new.withColumnRenamed("c", "_c").join(F.broadcast(best.select("id", "c1")), "id", "left").select("id", "k", F.coalesce("c1", "_c").alias("c"), "loops", "n"), "labels")  # one row
            if whole:
                labels = new
                break
            now = _quality(both, new, m)
            if now <= quality + (least if turn else EPSILON):
                labels = new if now > quality else labels
                break
            labels, quality = new, now
        place = labels.select("id", "c")
        if place.where("id <> c").isEmpty() or place.groupBy("c").count().count() == place.count():
            break
        member = written(member.join(place.withColumnRenamed("id", "node"), "node").select("id", F.col("c").alias("node")), "members")
        if whole:
            break
        ends = both.join(place.select(F.col("id").alias("src"), F.col("c").alias("_a")), "src").join(place.select(F.col("id").alias("dst"), F.col("c").alias("_b")), "dst")
        summed = written(ends.groupBy(F.col("_a").alias("src"), F.col("_b").alias("dst")).agg(F.sum("w").alias("w")), "undirected")
        inner = summed.where("src = dst").select(F.col("src").alias("id"), F.col("w").alias("_inner"))
        both = written(summed.where("src <> dst"), "undirected")
        degree = both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
        sums = labels.groupBy(F.col("c").alias("id")).agg(F.sum("k").alias("k"), F.sum("loops").alias("_loops"))
        told = sums.join(inner, "id", "left").join(degree, "id", "left")
        labels = written(told.select("id", "k", F.col("id").alias("c"), (F.col("_loops") + F.coalesce("_inner", F.lit(0))).alias("loops"), F.coalesce("n", F.lit(0)).cast("long").alias("n")), "labels")
    names = member.groupBy("node").agg(F.min("id").alias("community"))
    return member.join(names, "node").select("id", "community")


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: the modularity of a partition ``id, community`` of the undirected simple graph."""
    plain = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    named = plain.join(parts.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(parts.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    m = named.agg(F.count("*").alias("m"))
    inside = named.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.count("*").alias("l"))
    degree = named.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count("*").alias("d"))
    each = degree.join(inside, "c", "left").crossJoin(F.broadcast(m))  # one row
    return each.agg(F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"))


# Maps ---------------------------------------------------------------------------------------------------------------


def map_nodes(edges: DataFrame, ids: DataFrame, depth: int | None = None) -> DataFrame:
    """``id`` of the nodes that a map shows: those within ``depth`` of its entries, all without a depth.

    Entries are nodes that nothing leads to; else well-known files; else all nodes.
    """
    if depth is None or depth < 0:
        return ids.select("id")
    entries = in_degree(simple_digraph(edges), ids).where("n = 0").select("id")
    if entries.isEmpty():
        met = F.lit(False)
        for e in MAP_ENTRIES:
            met = met | F.col("id").endswith(e)
        entries = ids.where(met).select("id")
        if entries.isEmpty():
            entries = ids.select("id")
    return distances(simple_digraph(edges), entries, most=depth).select("id")


# Dead code ----------------------------------------------------------------------------------------------------------


def is_entry_file(path: Column) -> Column:
    return F.lower(path).rlike(ENTRY_FILE)


def decorated(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``symbol_id`` of symbols with a route decorator on one of the four lines up to theirs."""
    hits = lines(files).where(F.col("line").rlike(ROUTE_DECORATOR)).select("file_path", "line_no")
    spread = hits.select("file_path", F.explode(F.sequence(F.col("line_no"), F.col("line_no") + 3)).alias("start_line")).distinct()
    return symbols.join(spread, ["file_path", "start_line"], "left_semi").select("symbol_id")


def reference_edges(symbols: DataFrame, imports: DataFrame, edges: DataFrame) -> DataFrame:
    """``src, dst`` of everything that keeps something alive: symbols their files, callers their callees, files what they import by file and by name."""
    resolved = imports.select("file_path", "target", "imported_names").distinct()
    named = resolved.select("file_path", "target", F.explode("imported_names").alias("name"))
    return (
        symbols.select(F.col("symbol_id").alias("src"), F.col("file_path").alias("dst"))
        .union(edges.select("src", "dst"))
        .union(resolved.select("file_path", "target"))
        .union(named.where("name <> '*'").select("file_path", F.concat_ws("#", "target", "name")))
        .union(named.where("name = '*'").join(symbols.where("is_exported").select(F.col("file_path").alias("target"), "symbol_id"), "target").select("file_path", "symbol_id"))
        .distinct()
    )


def dead_code(files: DataFrame, symbols: DataFrame, imports: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Tables ``files`` (is_reachable, references), ``dead_files``, ``dead_functions``, ``dead_exports``."""
    starts = (
        files.where(is_entry_file(F.col("file_path"))).select(F.col("file_path").alias("id"))
        .union(symbols.where(is_entry_file(F.col("file_path"))).select("symbol_id"))
        .union(decorated(symbols, files))
    )
    live = written(reachable(reference_edges(symbols, imports, edges), starts), "live")
    counts = edges.where("edge_type = 'imports'").groupBy(F.col("dst").alias("file_path")).agg(F.count("*").alias("references"))
    told = files.select("file_path").join(live.select(F.col("id").alias("file_path"), F.lit(True).alias("_live")), "file_path", "left").join(counts, "file_path", "left")
    told = told.select("file_path", F.coalesce("_live", F.lit(False)).alias("is_reachable"), F.coalesce("references", F.lit(0)).cast("long").alias("references"))
    idle = symbols.where(~F.lower("name").isin("default", "main")).join(told.where("is_reachable").select("file_path"), "file_path", "left_semi").join(live.withColumnRenamed("id", "symbol_id"), "symbol_id", "left_anti")
    idle = idle.select("symbol_id", "name", "kind", "file_path", "start_line", "end_line", "is_exported")
    return {
        "files": told,
        "dead_files": told.where("NOT is_reachable").select("file_path", "references"),
        "dead_exports": idle.where("is_exported").drop("is_exported"),
        "dead_functions": idle.where(~F.col("is_exported") & F.lower("kind").isin(*FUNCTION_KINDS)).drop("is_exported"),
    }


# Traces -------------------------------------------------------------------------------------------------------------


def resolve_symbol(symbols: DataFrame, name: str) -> str:
    """The id of one symbol by ``file#name``, ``file:name`` or name; an error if there is none, or several."""
    if "#" in name or ":" in name:
        file, _, short = name.replace(":", "#").rpartition("#")
        held = symbols.where(F.contains("file_path", F.lit(file)) & (F.col("name") == short))
    else:
        held = symbols.where((F.col("name") == name) | (F.col("symbol_id") == name))
    found = [r["symbol_id"] for r in held.select("symbol_id").distinct().orderBy("symbol_id").limit(20).collect()]  # for the message
    if not found:
        raise LookupError(f"no symbol named {name}")
    if len(found) > 1:
        raise LookupError(f"{name} is ambiguous: {', '.join(found)}")
    return found[0]


def trace(edges: DataFrame, symbols: DataFrame, root: str, *, direction: str = "down", depth: int = 3) -> DataFrame:
    """``step, depth, node, name, file_path, start_line, end_line, is_cycle`` in preorder; unknown nodes are external."""
    start = edges.sparkSession.range(1).select(F.lit(root).alias("id"))
    walk = bounded_walk(edges, start, depth, direction).join(symbols.select(F.col("symbol_id").alias("node"), "name", "file_path", "start_line", "end_line", "kind"), "node", "left")
    step = F.row_number().over(Window.partitionBy("root").orderBy("path"))
    return walk.select(
        step.alias("step"), "depth", "node", F.coalesce("name", F.element_at(F.split("node", "#"), -1)).alias("name"), F.coalesce("file_path", F.lit("external")).alias("file_path"),
        F.coalesce("start_line", F.lit(1)).alias("start_line"), F.coalesce("end_line", F.lit(1)).alias("end_line"), F.coalesce("kind", F.lit("external")).alias("kind"), "is_cycle",
    )
