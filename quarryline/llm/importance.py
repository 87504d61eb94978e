"""Importance resampling toward a target distribution, over hashed runs of words.

Each task walks its texts through word tries: an edge is a word, a node the run of words from the root to it. A node holds
how often its run was met and its CRC state, which is its parent's state moved on by the edge's bytes, so that the CRC of
a run is never computed from its text. Counts are added up by bucket (CRC modulo ``buckets``) and merged over tasks. From
the totals of documents and target each bucket gets a gain; a second walk over the same kind of tries, with gains attached
to their nodes, adds up each document's gains. Keys of Gumbel noise make the draw without replacement a top list.

The trie's first level lives as long as its task but is emptied beyond ``MOST_WORDS`` words; deeper levels live for a
group of texts. What was counted is in the bucket totals by then, so neither limit changes a result.

Defined results: null and empty texts, and texts without words, have no features and weight 0; they are scored but need
``min_words`` words to be drawn. Texts are read whole. A null id is hashed as ``null`` and stands before other ids in ties.
Repeated rows are scored and drawn each; rows that are equal in score and id rank in any order. An empty table, or one
without a text of ``min_words`` words, draws nothing; an empty target has totals of 0. Other columns are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm._common import materialize, rank_within

#: Words that a trie's first level may hold, and bytes of texts whose deeper levels are built together.
MOST_WORDS = 400_000
GROUP_BYTES = 4 << 20
#: Bytes of words stay, A-Z in lower case; all others separate.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_BYTE = np.arange(256, dtype=np.uint32)
#: Scores are first counted in bins of this many.
BIN = 256


@functools.cache
def _moves(power: int) -> np.ndarray:
    """Tables (4 by 256) that move a CRC on by ``2**power`` zero bytes, one for each of its bytes."""
    start = _BYTE[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    if power:
        return _moved(_moved(start, _moves(power - 1)), _moves(power - 1))
    step = _BYTE.copy()
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    return step[start & 255] ^ (start >> 8)


def _moved(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


@functools.lru_cache(maxsize=1024)
def _move_by(n_bytes: int) -> np.ndarray:
    tables = _BYTE[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for power in range(n_bytes.bit_length()):
        if n_bytes >> power & 1:
            tables = _moved(tables, _moves(power))
    return tables


def extended(states: np.ndarray, added: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC states of texts after ``added``, the CRCs of what follows, of ``lengths`` bytes."""
    sizes, at = np.unique(lengths, return_inverse=True)
    if not len(sizes):
        return states
    tables = np.stack([_move_by(int(n)) for n in sizes])
    return tables[at, 0, states & 255] ^ tables[at, 1, (states >> 8) & 255] ^ tables[at, 2, (states >> 16) & 255] ^ tables[at, 3, states >> 24] ^ added


class _Edges(dict):
    """Words of the first level by number, with what their nodes and the edges below them need."""

    def __init__(self) -> None:
        self.states: list[int] = []
        self.added: list[int] = []
        self.lengths: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.states.append(zlib.crc32(word))
        self.added.append(zlib.crc32(b" " + word))
        self.lengths.append(len(word) + 1)
        return number


class WordTrie:
    """The trie of one task; ``walk`` gives the levels of a group of texts."""

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.edges = _Edges()

    def walk(self, texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each level: (text of each run that is met, its node, CRC states of the nodes)."""
        if len(self.edges) > MOST_WORDS:
            self.edges = _Edges()
        edges, n = self.edges, sum(map(len, texts))
        words = np.fromiter((number for text in texts for number in map(edges.__getitem__, text)), dtype=np.int64, count=n)
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        states, added, lengths = np.array(edges.states, dtype=np.uint32), np.array(edges.added, dtype=np.uint32), np.array(edges.lengths, dtype=np.int64)
        nodes = words
        yield text, nodes, states
        for level in range(1, self.depth):
            nodes = nodes[:-1] if len(nodes) else nodes
            ends = words[level:]
            paths, nodes = np.unique(nodes * len(edges) + ends, return_inverse=True)
            edge = paths % max(1, len(edges))
            states = extended(states[paths // max(1, len(edges))], added[edge], lengths[edge])
            within = text[: len(ends)] == text[level:]
            yield text[: len(ends)][within], nodes[within], states


def _groups(column: pa.Array) -> Iterator[list[list[bytes]]]:
    """Words of the texts of a column, in groups of about ``GROUP_BYTES``; a longer text is a group of its own."""
    held, size = [], 0
    for value in column:
        text = value.as_py() or b""
        held.append(text.translate(_FOLD).split())
        size += len(text)
        if size >= GROUP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def bucket_totals(docs: DataFrame, *, text_col: str = "text", buckets: int = 10_000, runs: int = 2) -> DataFrame:
    """``bucket, n``: how many features of all texts fall in each bucket."""
    rows = docs.select(F.col(text_col).cast("binary").alias("text"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, totals = WordTrie(runs), np.zeros(buckets, dtype=np.int64)
        for batch in source:
            for texts in _groups(batch.column("text")):
                for _, nodes, states in trie.walk(texts):
                    counts = np.bincount(nodes, minlength=len(states))
                    np.add.at(totals, states % buckets, counts)
        met = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(totals[met], pa.int64())], ["bucket", "n"])

    return rows.mapInArrow(batches, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, *, text_col: str = "text", buckets: int = 10_000, runs: int = 2) -> np.ndarray:
    """The gain of each bucket; the totals that it is made of are ``buckets`` numbers, whatever the input."""
    told = []
    for df in (docs, target):
        totals = np.zeros(buckets, dtype=np.int64)
        for r in bucket_totals(df, text_col=text_col, buckets=buckets, runs=runs).collect():
            totals[r["bucket"]] = r["n"]
        told.append(totals.astype(np.float64))
    s, t = told
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", runs: int = 2) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row; ``gain`` has a number for each bucket."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, gain = WordTrie(runs), shared.value
        for batch in source:
            told: list[list[np.ndarray]] = [[], [], []]
            for texts in _groups(batch.column("text")):
                n_features, sums = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
                for text, nodes, states in trie.walk(texts):
                    n_features += np.bincount(text, minlength=len(texts))
                    attached = gain[states % len(gain)][nodes]
                    ends = np.searchsorted(text, np.arange(len(texts) + 1))
                    before = np.concatenate([[0], np.cumsum(attached)])
                    sums += before[ends[1:]] - before[ends[:-1]]
                told[0].append(np.array([len(t) for t in texts], dtype=np.int64))
                told[1].append(n_features)
                told[2].append(sums // np.maximum(n_features, 1))
            columns = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in told]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_features", "weight"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"doc_id {id_type}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise of a key in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _cutoff(scored: DataFrame, n: int) -> int | None:
    """The ``n``-th highest score, by counts of bins and then of the scores of one bin."""
    for bins in (F.floor(F.col("score") / BIN), F.col("score")):
        left = n
        for r in sorted(scored.groupBy(bins.alias("at")).count().collect(), reverse=True):
            if r["count"] >= left:
                break
            left -= r["count"]
        else:
            return None
        scored, n = scored.where(bins == r["at"]), left
    return r["at"]


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 25, min_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000, runs: int = 2) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of each row; ``rank`` is null where the row is not drawn.

    ``percent`` of the rows with at least ``min_words`` words are drawn. Only rows at or above the last score that is drawn
    are sorted, by range over many tasks.
    """
    gain = gains(docs, target, text_col=text_col, buckets=buckets, runs=runs)
    told = weigh(docs, gain, id_col=id_col, text_col=text_col, runs=runs)
    scored = materialize(told.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    fit = scored.where(F.col("n_words") >= min_words)
    n_drawn = percent * fit.count() // 100
    cutoff = _cutoff(fit, n_drawn) if n_drawn else None
    if cutoff is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = (F.col("n_words") >= min_words) & (F.col("score") >= cutoff)
    ranked = rank_within(scored.where(high).withColumns({"draw": F.lit(0), "falling": -F.col("score")}), "draw", ["falling", "doc_id"], "place")
    place = F.col("place") + 1
    drawn = ranked.select(*scored.columns, F.when(place <= n_drawn, place).cast("long").alias("rank"))
    return drawn.unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))
