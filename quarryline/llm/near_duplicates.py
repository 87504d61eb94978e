"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Texts are sets of shingles of five words. Equal texts form copy classes first, of which the one with the smallest id
stands for all. A forest of ``TREES`` prefix trees holds ``DEPTH`` MinHash values of each representative in each tree,
sorted by prefix. Matching starts at full prefixes. The similarities of the links found there, each weighed by the chance
that such a link is found, tell what shorter prefixes would find; prefixes are shortened only as far as the target recall
asks for on this corpus, with one more link at the threshold assumed so that few links tell little, and at least to the
length at which a pair at the threshold itself is found with ``BAND_RECALL``, so that a corpus of close copies does not
trade its other pairs away. Where no link is found prefixes go down to the length that meets the target for such a pair.

Nodes with a member in common are one component, and pairs are compared by their whole shingle sets, in blocks of two parts.
A component of up to ``PART`` texts, or one whose texts mostly share nodes, is compared as a whole. Of another one, whose
texts are tied together over others (by a site's template, say), only texts that share a node are: nodes of equal members
are one, and a pair counts in the first tree whose node it shares. What is compared is the lesser of the two, in pairs, so
that every pair which shares a prefix is.

Links join texts into groups. Each block gives the number of links of its texts and ways that connect them; the links
themselves are listed only when they are read, for there the rows grow with the square of a group.

Defined results: ids are integers, others are refused; a text of fewer than five words is one shingle; texts without
words are copies of equal texts only; null texts and null ids are groups of their own; repeated rows are copies; texts
of any length are compared whole; an empty table gives none; columns besides id and text are not read. Where one id has
several texts, each is a class of its own: the text with the least digest goes by the id, each other by a number of its
own above 2**62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm._common import fits_broadcast, materialize
from quarryline.llm.wordhash import groups, run_hashes, word_hashes

WORDS = 5
THRESHOLD = 0.8
TREES = 12
DEPTH = 8
RECALL = 0.998
BAND_RECALL = 0.97
#: Rows that share a text, from which on they meet its class by a broadcast; so many texts at most are broadcast, whatever the input.
MANY_COPIES = 1000
MOST_BROADCAST = 50_000
#: Members and bytes of shingles that a part of a component has, about; columns of shingles that are compared at a time.
PART = 128
PART_BYTES = 16 << 20
SLAB = 2048
BLOCK = ("group", "tree", "low", "high")


def shingles(texts: list[str | None] | pa.Array, n: int = WORDS) -> Iterator[np.ndarray]:
    """Distinct hashes of the shingles of each text, sorted."""
    for _, some in groups(texts):
        hashes, lens = word_hashes(some)
        ends = np.cumsum(lens)
        for end, count in zip(ends.tolist(), lens.tolist(), strict=True):
            yield np.unique(run_hashes(hashes[end - count : end], min(n, count))) if count else np.empty(0, dtype=np.uint64)


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Least 32-bit value of the shingles under each multiplier."""
    out = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(found), 4096):
        block = (found[at : at + 4096, None] * factors[None, :]) >> np.uint64(32)
        np.minimum(out, block.min(axis=0).astype(np.uint32), out=out)
    return out


def recall(depth: int, trees: int = TREES, threshold: float = THRESHOLD) -> float:
    """The chance that two texts at the threshold share a prefix of ``depth`` in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def shortest(target: float = RECALL, trees: int = TREES, deepest: int = DEPTH, threshold: float = THRESHOLD) -> int:
    """The longest prefix that meets the target recall for a pair at the threshold, 1 if none does."""
    return next((d for d in range(deepest, 0, -1) if recall(d, trees, threshold) >= target), 1)


def adapted(found: dict[float, int], target: float = RECALL, trees: int = TREES, deepest: int = DEPTH, threshold: float = THRESHOLD) -> int:
    """The longest prefix that meets the target recall over the links of the corpus, from the number of links by similarity (its lower bound) found at full prefixes."""
    if not found:
        return shortest(target, trees, deepest, threshold)
    there = [(j, n / recall(deepest, trees, j)) for j, n in {**found, threshold: found.get(threshold, 0) + 1}.items()]
    total = sum(n for _, n in there)
    return next((d for d in range(deepest, 0, -1) if sum(n * recall(d, trees, j) for j, n in there) >= target * total), 1)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, key, sig`` (null for a text without words)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    if not isinstance(rows.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError(f"{id_col}: ids must be integers")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(TREES * DEPTH)
        for batch in source:
            sigs = [signature(s, factors).astype(">u4").tobytes() if len(s) else None for s in shingles(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(sigs, pa.binary())], ["doc_id", "key", "sig"])

    return rows.mapInArrow(batches, f"doc_id {kind}, key binary, sig binary")


def shared_nodes(reps: DataFrame, depth: int) -> DataFrame:
    """``rep, tree, node, first``: the nodes of prefixes of ``depth`` that two representatives or more share, and the least of these.

    Nodes are counted in a table of their own, so that a node of very many texts is one row of a join whose other side can be split.
    """
    width = 4 * DEPTH
    trees = reps.where("sig IS NOT NULL").select("rep", F.posexplode(F.array(*[F.substring("sig", 1 + t * width, width) for t in range(TREES)])).alias("tree", "branch"))
    nodes = trees.select("rep", "tree", F.xxhash64("tree", F.substring("branch", 1, 4 * depth)).alias("node"))
    shared = materialize(nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("first")).where("n > 1").select("node", "first"), "shared-nodes")
    return nodes.join(F.broadcast(shared) if fits_broadcast(shared) else shared, "node").select("rep", "tree", "node", "first")


def node_links(nodes: DataFrame) -> DataFrame:
    """``a, b``: each member of a node with the node's least member.

    Texts that share a longer prefix share a shorter one too. Nodes that have a member in common are one component of these links.
    """
    return nodes.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()


def comparisons(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """``node (a representative), group, tree, places``: whose members are to be compared. A group is a component (tree -1), or a node of a component whose nodes hold fewer pairs than it does; ``places`` are the nodes of a representative by tree, for its pairs to be counted once."""
    sizes = near.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > PART)
    large = materialize(near.join(sizes, "group"), "large-components")
    if large.isEmpty():
        return near.select("node", "group", F.lit(-1).alias("tree"), F.lit(None).cast("map<int,bigint>").alias("places"))
    held = materialize(nodes.join(large.select(F.col("node").alias("rep"), "group", F.col("n").alias("whole")), "rep"), "large-nodes")
    each = F.xxhash64("rep")
    sets = held.groupBy("node", "tree", "group", "whole").agg(F.count("*").alias("n"), F.bit_xor(each).alias("x"), F.sum(F.shiftright(each, 20)).alias("s"))
    first = sets.groupBy("group", "whole", "n", "x", "s").agg(F.min(F.struct("tree", "node")).alias("m"))
    pairs = materialize(first.select("group", "whole", "n", "m.tree", "m.node"), "node-sets")
    square = lambda n: F.col(n).cast("double") * (F.col(n) - 1)
    split = materialize(pairs.groupBy("group", "whole").agg(F.sum(square("n")).alias("apart")).where(F.col("apart") < square("whole")).select("group"), "split-components")
    few = lambda df: F.broadcast(df) if fits_broadcast(df) else df
    whole = near.join(few(split), "group", "left_anti").select("node", "group", F.lit(-1).alias("tree"), F.lit(None).cast("map<int,bigint>").alias("places"))
    kept = pairs.join(few(split), "group", "left_semi").select("node", "tree")
    places = held.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("tree", "node"))).alias("places"))  # one for each tree
    apart = held.select("rep", "tree", "node").join(kept, ["tree", "node"], "left_semi").join(places, "rep")
    return whole.unionByName(apart.select(F.col("rep").alias("node"), F.col("node").alias("group"), "tree", "places"))


def copy_classes(sigs: DataFrame) -> DataFrame:
    """``key, doc, rep, n_copies, sig``: one row for each different text; ``doc`` is the smallest id that has it and ``rep`` the number that it goes by."""
    classes = materialize(sigs.groupBy("key").agg(F.min(F.col("doc_id").cast("long")).alias("doc"), F.count("*").alias("n_copies"), F.min("sig").alias("sig")), "copy-classes")
    clashes = materialize(classes.groupBy("doc").agg(F.count("*").alias("n"), F.min("key").alias("own")).where("n > 1").select(F.col("doc").alias("clash"), "own"), "clashes")
    met = classes.join(F.broadcast(clashes) if fits_broadcast(clashes) else clashes, F.col("doc") == F.col("clash"), "left")
    other = F.lit(1 << 62) + F.xxhash64("doc", "key").bitwiseAND(F.lit((1 << 62) - 1))
    return met.select("key", "doc", F.when(F.col("own") != F.col("key"), other).otherwise(F.col("doc")).alias("rep"), "n_copies", "sig")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """``rep, shingles`` of the texts ``wanted(rep, doc, key)``, one row for each."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    few = F.broadcast(wanted) if fits_broadcast(wanted) else wanted

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([s.tobytes() for s in shingles(batch.column("text"))], pa.binary())], ["rep", "shingles"])

    return rows.join(few, ["doc", "key"]).select("rep", "text").mapInArrow(batches, "rep long, shingles binary").dropDuplicates(["rep"])


def components(links: DataFrame) -> DataFrame:
    """``node, group``: the smallest node that links lead to, for each node with a link.

    Each round takes the least label among neighbours and then the label of that label, so that rounds grow with the
    logarithm of a path; labels lie in written tables, and only the count of changes comes to the driver.
    """
    both = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")), "edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        best = labels.join(near, labels.node == near.u).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        new = materialize(best.join(jump, "low", "left").select("node", F.least("low", "lower").alias("label"), F.col("label").alias("before")), "labels")
        labels = new.select("node", "label")
        if not new.where("label <> before").limit(1).count():
            return labels.withColumnRenamed("label", "group")


def blocks(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """``group, tree, low, high, part, rep, places, shingles``: groups dealt out in parts of about ``PART`` members or ``PART_BYTES`` of shingles, each pair of parts (and each part by itself) a block.

    Two members of a group meet in exactly one block as members of ``low`` and ``high``.
    """
    members = materialize(groups.withColumnRenamed("node", "rep").join(sets, "rep"), "members")
    by = ["group", "tree"]
    sizes = members.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"))
    parts = F.ceil(F.greatest(F.col("n") / PART, F.col("bytes") / PART_BYTES)).cast("int")
    large = materialize(sizes.select(*by, parts.alias("parts")).where("parts > 1"), "large-groups")
    dealt = members.join(F.broadcast(large) if fits_broadcast(large) else large, by, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = dealt.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    spread = placed.select(*by, "part", "rep", "places", "shingles", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return spread.select(*by, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "rep", "places", "shingles")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = held[col] > 1  # the others are in no two sets
    row, col = row[common], (np.cumsum(held > 1) - 1)[col[common]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = int(col[-1]) + 1 if len(col) else 0
    out = np.zeros((len(sets), len(sets)))
    for at in range(0, width, SLAB):
        i, j = np.searchsorted(col, (at, at + SLAB))
        dense = np.zeros((len(sets), min(SLAB, width - at)), dtype=np.float32)
        dense[row[i:j], col[i:j] - at] = 1
        out += dense @ dense.T
    return out


def block_links(block: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(members' ids, places of the one and of the other text, jaccard, whether the pair is this block's own) of the pairs at the threshold or above; all pairs are compared.

    A pair within one part is the own pair of the block of that part by itself only, and a pair that shares nodes of
    several trees that of the first of them.
    """
    block = block.sort_by("rep")  # so the least places are the least ids, and blocks agree on them
    ids, part = block.column("rep").to_numpy(), block.column("part").to_numpy()
    sets = [np.frombuffer(v.as_py(), dtype=np.uint64) for v in block.column("shingles")]
    both = shared_counts(sets)
    lens = np.array([len(s) for s in sets], dtype=np.float64)
    jaccard = both / (lens[:, None] + lens[None, :] - both)
    x, y = np.nonzero(np.triu(jaccard >= threshold, 1))
    alone = block.column("low")[0].as_py() == block.column("high")[0].as_py()
    own = (part[x] != part[y]) | alone
    tree = block.column("tree")[0].as_py()
    if tree > 0:
        places = [dict(v.as_py()) for v in block.column("places")]
        at = np.array([[p.get(t, -1 - t) for t in range(tree)] for p in places], dtype=np.int64)
        there = np.array([[t in p for t in range(tree)] for p in places])
        for t in range(tree):
            own &= ~((at[x, t] == at[y, t]) & there[x, t] & there[y, t])
    return ids, x, y, jaccard[x, y], own


def least_places(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after the pairs of places have passed on the least ones."""
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        if (new == label).all():
            return label
        label = new


def listed(dealt: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs ``a < b, jaccard`` at the threshold or above, by their whole shingle sets."""

    def pairs(block: pa.Table) -> pa.Table:
        ids, x, y, jaccard, own = block_links(block, threshold)
        x, y, jaccard = x[own], y[own], jaccard[own]
        return pa.table({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y]), "jaccard": jaccard})

    return dealt.groupBy(*BLOCK).applyInArrow(pairs, "a long, b long, jaccard double")


def counted(dealt: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """What the links of each block come to, in rows that grow with its members and not with their pairs: ``a, n_links`` for each text with links, ``a, b`` for links (or ways over several) that connect the same texts, ``percent, n_links`` for the links of a similarity."""

    def sums(block: pa.Table) -> pa.Table:
        ids, x, y, jaccard, own = block_links(block, threshold)
        degree = np.bincount(x[own], minlength=len(ids)) + np.bincount(y[own], minlength=len(ids))
        linked = np.flatnonzero(degree)
        places = np.arange(len(ids))
        known = least_places(places, x[~own], y[~own])  # ways within one part; the part's own block tells them
        label = least_places(known, x, y)
        led = np.flatnonzero((known == places) & (label != places))
        percent, many = np.unique(np.floor(100 * jaccard[own]).astype(np.int32), return_counts=True)
        rows = [(a, None, n, None) for a, n in zip(ids[linked].tolist(), degree[linked].tolist(), strict=True)]
        rows += [(a, b, None, None) for a, b in zip(ids[label[led]].tolist(), ids[led].tolist(), strict=True)]
        rows += [(None, None, n, p) for p, n in zip(percent.tolist(), many.tolist(), strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], names=["a", "b", "n_links", "percent"])

    return dealt.groupBy(*BLOCK).applyInArrow(sums, "a long, b long, n_links long, percent int")


def compared(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, depth: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(blocks, their sums) of the components of prefixes of ``depth``."""
    nodes = materialize(shared_nodes(classes, depth), "nodes")
    near = components(materialize(node_links(nodes), "node-links"))
    wanted = classes.select("rep", "doc", "key").join(near.select(F.col("node").alias("rep")), "rep", "left_semi")
    dealt = blocks(comparisons(nodes, near), shingle_sets(docs, id_col, text_col, wanted))
    return dealt, materialize(counted(dealt, threshold), "link-sums")


def _with_classes(rows: DataFrame, notable: DataFrame) -> DataFrame:
    """Rows with what is told of their text. Texts of very many rows are broadcast to them, at most ``MOST_BROADCAST`` of them, so that no task gets all rows of a text."""
    told = materialize(notable, "notable")
    total = told.agg(F.sum("n_copies").alias("n")).first()["n"] or 0
    many = F.col("n_copies") > max(MANY_COPIES, total // MOST_BROADCAST)
    met = rows.join(F.broadcast(told.where(many)), F.col("key") == F.col("k"), "left")
    others = met.where("k IS NULL").select("doc_id", "key").join(told.where(~many), F.col("key") == F.col("k"), "left")
    return met.where("k IS NOT NULL").unionByName(others)


def near_duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, target: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(memberships, links). Memberships, one row for each document with id and text: ``doc_id, rep_id`` (the copy class), ``class_id`` (the group) ``, n_links, n_copies, first_id`` (the smallest id of the copy class) ``, text_key``; links: ``a, b, jaccard`` between copy classes."""
    usable = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    sigs = materialize(signatures(usable, id_col, text_col), "signatures")
    classes = materialize(copy_classes(sigs), "classes")
    dealt, sums = compared(usable, id_col, text_col, classes, DEPTH, threshold)
    found = {r["percent"] / 100: r["n"] for r in sums.where("percent IS NOT NULL").groupBy("percent").agg(F.sum("n_links").alias("n")).collect()}  # a row for each percent
    depth = min(adapted({max(threshold, j): n for j, n in found.items()}, target, threshold=threshold), shortest(BAND_RECALL, threshold=threshold))
    if depth < DEPTH:
        dealt, sums = compared(usable, id_col, text_col, classes, depth, threshold)
    links = listed(dealt, threshold)
    groups = components(sums.where("b IS NOT NULL").select("a", "b"))
    degree = sums.where("a IS NOT NULL AND b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n_links").alias("n_links"))
    told = classes.select("key", "doc", "rep", "n_copies").join(groups.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    notable = told.where("n_copies > 1 OR n_links > 0 OR rep <> doc").select(F.col("key").alias("k"), "doc", "rep", "n_copies", "group", "n_links")
    joined = _with_classes(sigs.select("doc_id", "key"), notable)
    own = F.col("doc_id").cast("long")
    memberships = joined.select(
        "doc_id",
        F.coalesce("rep", own).alias("rep_id"),
        F.coalesce("group", "rep", own).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("doc", own).alias("first_id"),
        F.col("key").alias("text_key"),
    )
    id_ = F.col(id_col)
    alone = docs.where(id_.isNull() | F.col(text_col).isNull()).select(
        id_.alias("doc_id"), id_.cast("long").alias("rep_id"), id_.cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), id_.cast("long").alias("first_id"), text_key(F.col(text_col)).alias("text_key")
    )
    return memberships.unionByName(alone), links
