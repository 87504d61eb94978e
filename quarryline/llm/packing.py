"""Packing of tokenized documents into sequences of a fixed size, best fit decreasing.

A document's ids, closed by an end id, are cut into full windows and one rest. Rests go, longest first, each into the
open sequence with the least room that still fits. A segment tree indexed by remaining room finds that sequence.

Rests of one length are alike, so the placing runs over the counts by length: at most ``size`` rows, whatever the input.
Its plan says for runs of equal rests into which run of sequences they go; a row finds its place from its rank among the
rests of its length. This is the same packing as placing one rest after the other, at any scale.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm._common import materialize, rank_within
from quarryline.llm.pretokens import encoder

SIZE = 2048
END_ID = 1


def cut_pieces(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: the full windows and the rest of each document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary)
        for batch in source:
            source_row, start, length, crc, total = [], [], [], [], []
            for row, value in enumerate(batch.column("text")):
                ids = known.encode_to_numpy(value.as_py() or "", allowed_special="all").astype("<u4", copy=False).tobytes() + end
                n = len(ids) // 4
                for at in range(0, n, size):
                    piece = ids[4 * at : 4 * (at + size)]
                    source_row.append(row)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(source_row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long")


class RoomTree:
    """A segment tree over the room 0 to ``size`` of open sequences; it finds the least room of at least ``need``."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, room: int, there: bool) -> None:
        node = room + self.leaves
        self.any[node] = there
        while node := node >> 1:
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, need: int) -> int | None:
        node = need + self.leaves
        if self.any[node]:
            return need
        while node > 1 and not (node % 2 == 0 and self.any[node + 1]):
            node >>= 1
        if node <= 1:
            return None
        node += 1
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves


def plan_sequences(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, n, sequence, per, offset): rests ``first`` to ``first + n - 1`` of a length go ``per`` to a sequence, from ``sequence`` on, from ``offset`` on.

    Placed one by one, equal rests fill the tightest sequence until no more fits, then the next; so whole runs of
    sequences with the same room take the same number each.
    """
    tree, runs, plan, opened = RoomTree(size), [deque() for _ in range(size + 1)], [], 0

    def add(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            runs[room].append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left > 0:
            room = tree.tightest(length)
            if room is None:
                room, first, there = size, opened, -(-left // (size // length))
                opened += there
            else:
                first, there = runs[room].popleft()
                tree.set(room, bool(runs[room]))
            per = room // length
            full = min(there, left // per)
            if full:
                plan.append((length, done, full * per, first, per, size - room))
                add(room - per * length, first, full)
                done, left = done + full * per, left - full * per
            if full < there and left:
                plan.append((length, done, left, first + full, per, size - room))
                add(room - left * length, first + full, 1)
                done, left, full = done + left, 0, full + 1
            if full < there:
                runs[room].appendleft((first + full, there - full))
                tree.set(room, True)
    return plan


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, one row for each piece."""
    pieces = materialize(cut_pieces(docs, vocabulary, id_col=id_col, text_col=text_col, size=size, end_id=end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    plan = docs.sparkSession.createDataFrame(plan_sequences(counts, size), "len long, first long, n long, sequence long, per long, at long")
    ranked = rank_within(pieces, "length", ["doc_id", "start", "ids_crc32"], "rank")
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    k = F.col("rank") - F.col("first")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.floor(k / F.col("per"))).cast("long").alias("sequence_id"), (F.col("at") + k % F.col("per") * F.col("length")).cast("long").alias("offset"))
