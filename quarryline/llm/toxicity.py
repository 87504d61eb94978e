"""Toxic documents and the sentences that make them so, learned from labels of whole documents.

Multiple-instance learning: a document is a bag of sentences. A sentence's score is a logistic function of its features;
a document's is their noisy-or, ``1 - prod(1 - p)``, so one toxic sentence is enough and clean ones need not agree. Only
documents have labels; the gradient of the document's likelihood reaches each sentence by its share in the noisy-or.
A sentence that stands again, with the same words, is no new evidence and counts once.

Features of a sentence are its distinct words in lower case and the beginnings of 3 to 8 letters of each, so that forms of
a stem that labels never showed are met too. They are hashed into ``2**18`` weights, of which those count that at least
``LEAST_ROWS`` rows have; they start at half the log ratio of the share of toxic rows and of clean rows that have them.

Learning takes a bounded sample of labelled rows (``MOST_TOXIC`` and ``MOST_CLEAN``, those with the least hash of the id),
dealt to parts of about ``PART_ROWS``. In each round every part goes through its documents from the common weights, and the
parts' weights are averaged by bucket in Spark; the driver holds the ``2**18`` averages. Both classes weigh the same.

Defined results: null and empty texts, and texts without words, have no sentences and score 0. Texts are read whole and a
sentence may be of any length. A null id has no label and counts as held out. Of repeated labels of an id the largest
counts, null labels don't; of repeated ids one text is learned from, and each row is scored. With no label to learn from
every score is 0. An empty table gives an empty result. Columns besides id and text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm._common import materialize

#: Most labelled documents that are learned from, of each class.
MOST_TOXIC = 3000
MOST_CLEAN = 6000
PART_ROWS = 1000
ROUNDS = 2
PASSES = 2
BUCKETS = 1 << 18
#: Rows of the sample that must have a feature.
LEAST_ROWS = 3
RATE = 0.2
DECAY = 1e-3
#: The score of a sentence without features, as log odds, before learning.
START = -6.0
SENTENCE = re.compile(r"[^.!?…。！？\n]*[^.!?…。！？\s][^.!?…。！？\n]*")
WORD = re.compile(r"\w+")
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Words whose features a task remembers at a time.
MOST_WORDS = 300_000


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether a row's label must not be learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(True))


def features(word: str) -> list[int]:
    """Buckets of a lower-case word: its own and those of its beginnings; where it is too short, the bucket without weight."""
    return [zlib.crc32(f"={word}".encode("utf-8", "replace")) % BUCKETS, *(zlib.crc32(word[:n].encode("utf-8", "replace")) % BUCKETS if len(word) >= n else BUCKETS for n in BEGINNINGS)]


def sentences(text: str | None) -> Iterator[tuple[int, int, frozenset[str]]]:
    """(start, end, distinct words) of each sentence with a word, in code points."""
    for m in SENTENCE.finditer(text or ""):
        if words := frozenset(WORD.findall(m[0].lower())):
            own = m[0]
            yield m.start() + len(own) - len(own.lstrip()), m.start() + len(own.rstrip()), words


class _Weighed(dict):
    """Words with the sum of their features' weights."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) > MOST_WORDS:
            self.clear()
        self[word] = total = sum([self.weights[k] for k in features(word)])
        return total


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def noisy_or(z: np.ndarray) -> float:
    """1 - prod(1 - p) of sentences with log odds ``z``."""
    return float(-np.expm1(-_softplus(z).sum()))


class Bags:
    """Labelled documents as arrays: words by number, their features, and the words of each sentence."""

    def __init__(self, texts: list[str | None]) -> None:
        number: dict[str, int] = {}
        self.docs = []
        for text in texts:
            words, of = [], []
            for k, own in enumerate(dict.fromkeys(own for _, _, own in sentences(text))):
                words += [number.setdefault(w, len(number)) for w in sorted(own)]
                of += [k] * len(own)
            self.docs.append((np.array(words, dtype=np.int64), np.array(of, dtype=np.int64), 1 + of[-1] if of else 0))
        self.features = np.array([features(w) for w in number], dtype=np.int64).reshape(len(number), 1 + len(BEGINNINGS))

    def gradient(self, at: int, weights: np.ndarray, toxic: bool) -> tuple[np.ndarray, np.ndarray, float]:
        """(buckets, their gradients, that of the bias) of a document's negative log-likelihood; ``weights`` end with the bias."""
        words, of, n = self.docs[at]
        held = self.features[words]
        z = weights[-1] + np.bincount(of, weights=weights[held].sum(1), minlength=n)
        slope = -1 / np.expm1(np.clip(_softplus(z).sum(), 1e-12, 50)) if toxic else 1.0
        by_sentence = slope * np.exp(-_softplus(-z))
        buckets, inverse = np.unique(held, return_inverse=True)
        return buckets, np.bincount(inverse.ravel(), weights=np.repeat(by_sentence[of], held.shape[1]), minlength=len(buckets)), float(by_sentence.sum())


def _learn_part(texts: list[str | None], toxic: list[bool], clean_weight: float, weights: np.ndarray, counted: np.ndarray, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that were met, their weights) after passes with AdaGrad steps; ``weights`` are those of all buckets, one that stays 0, and the bias."""
    bags, own = Bags(texts), weights.copy()
    squares = np.full(len(own), 1e-8)
    order = np.random.default_rng(len(texts)).permutation(len(texts))
    for k in np.tile(order, passes):
        if not bags.docs[k][2]:
            continue
        buckets, slopes, bias = bags.gradient(k, own, toxic[k])
        held = counted[buckets]
        at = np.append(buckets[held], len(own) - 1)
        g = np.append(slopes[held] + DECAY * own[buckets[held]], bias) * (1.0 if toxic[k] else clean_weight)
        squares[at] += g * g
        own[at] -= RATE * g / np.sqrt(squares[at])
    met = np.flatnonzero(squares > 1e-8)
    return met, own[met]


def labelled_sample(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> DataFrame:
    """``doc_id, toxic, text`` of the rows to learn from: the bounded sample, and one text for each id."""
    ids = docs.select(F.col(id_col).alias("doc_id")).distinct()
    told = labels.where(~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")).where("toxic IS NOT NULL").join(ids, "doc_id", "left_semi")
    told = materialize(told, "told")
    least = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = least(told.where("toxic > 0"), most_toxic).unionByName(least(told.where("toxic <= 0"), most_clean)).select(F.col("doc_id").alias("of_id"), (F.col("toxic") > 0).alias("toxic"))
    # At most most_toxic + most_clean rows of an id and a flag are broadcast.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("of_id"))
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def _count_rows(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``bucket, toxic, n``: how many rows of a task have a feature, by class."""
    n = np.zeros((2, BUCKETS + 1), dtype=np.int64)
    for rows in source:
        for text, toxic in zip(rows["text"], rows["toxic"], strict=True):
            n[int(toxic), list({k for _, _, words in sentences(text) for w in words for k in features(w)})] += 1
    for toxic in (0, 1):
        met = np.flatnonzero(n[toxic])
        yield pd.DataFrame({"bucket": met.astype(np.int32), "toxic": np.full(len(met), bool(toxic)), "n": n[toxic][met]})


def _part_learner(shared: Broadcast, clean_weight: float, passes: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def part(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        met, told = _learn_part(rows["text"].tolist(), rows["toxic"].tolist(), clean_weight, *shared.value, passes)
        return pd.DataFrame({"bucket": met.astype(np.int32), "weight": told})

    return part


def learn(docs: DataFrame, labels: DataFrame, *, rounds: int = ROUNDS, passes: int = PASSES, **columns) -> np.ndarray | None:
    """Weights of all buckets, one of 0 for features that a word doesn't have, and the bias; None without labels to learn from."""
    sample = materialize(labelled_sample(docs, labels, **columns), "labelled")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n:
        return None
    rows = np.zeros((2, BUCKETS + 1))
    for toxic, told in sample.mapInPandas(_count_rows, "bucket int, toxic boolean, n long").groupBy("toxic", "bucket").agg(F.sum("n").alias("n")).toPandas().groupby("toxic"):
        rows[int(toxic), told["bucket"].to_numpy()] = told["n"].to_numpy()
    counted = rows.sum(0) >= LEAST_ROWS
    counted[BUCKETS] = False
    toxic, clean = n.get(True, 0), n.get(False, 0)
    ratio = np.log((rows[1] + 0.5) / (toxic + 1)) - np.log((rows[0] + 0.5) / (clean + 1))
    weights = np.append(np.where(counted & (ratio > 0) & (rows[1] >= LEAST_ROWS), ratio / 2, 0.0), START)
    parts = sample.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(-(-(toxic + clean) // PART_ROWS))).cast("int"))
    for _ in range(rounds):
        part = _part_learner(docs.sparkSession.sparkContext.broadcast((weights, counted)), toxic / clean if toxic and clean else 1.0, passes)
        met = parts.groupBy("part").applyInPandas(part, "bucket int, weight double").groupBy("bucket").agg(F.avg("weight").alias("weight")).toPandas()
        weights = weights.copy()
        weights[met["bucket"].to_numpy()] = met["weight"].to_numpy()
    return weights


SENTENCES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def score(docs: DataFrame, weights: np.ndarray | None, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``doc_id, score, predicted, sentences`` of each row; ``sentences`` are those of at least ``least``, where they are and their own scores."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, line = shared.value, math.log(least / (1 - least))
        weigh = None if weights is None else _Weighed(weights).__getitem__
        for batch in source:
            told, found = [], []
            for value in batch.column("text"):
                if weigh is None:
                    told.append(0.0), found.append([])
                    continue
                held = list(sentences(value.as_py()))
                odds = {words: sum(map(weigh, words)) + weights[-1] for words in dict.fromkeys(words for _, _, words in held)}
                told.append(noisy_or(np.fromiter(odds.values(), dtype=np.float64, count=len(odds))))
                p = {words: 1 / (1 + math.exp(-z)) for words, z in odds.items() if z >= line}
                found.append([{"start": start, "end": end, "score": p[words]} for start, end, words in held if words in p] if p else [])
            columns = [pa.array(told, pa.float64()), pa.array([int(s >= 0.5) for s in told], pa.int32()), pa.array(found, SENTENCES)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "score", "predicted", "sentences"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"doc_id {id_type}, score double, predicted int, sentences array<struct<start:int,end:int,score:double>>")


def find_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, sentences``: learned from the labels that are not held out, told for each row."""
    told = score(docs, learn(docs, labels, id_col=id_col, text_col=text_col), id_col=id_col, text_col=text_col)
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "sentences")
