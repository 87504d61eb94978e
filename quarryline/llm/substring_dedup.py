"""Substring deduplication on a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words. Its fingerprint is the least hash among its inner runs of ``INNER`` words:
equal windows have equal fingerprints, and windows beside each other mostly share theirs, so that a document stores each
once. The index keeps runs: immutable tables in the shared folder, bucketed and sorted by fingerprint, with one row for
each fingerprint (and the least and the greatest id that has it), so that a passage of any number of documents is a few
rows. A new batch becomes a run and is merge-joined, bucket by bucket and without a shuffle, with the runs before it; what
matches names the few places that can repeat. There whole windows are compared, by 128 bits of two independent hashes.
``FANOUT`` runs of one level are merged, again bucket by bucket, into one of the next level, so that each row is written
once for each level. Beside the runs lie the documents of each fingerprint and, for an index that is kept, the packed
texts, with which later batches are verified against earlier ones.

Words under a window that also starts in a document with a smaller id are removed; windows are judged on the input. All
documents of an index that is given precede those of the call; with ids that grow from call to call, and no id in two
calls, several calls remove what one call on all documents would.
Copies of a whole text with a smaller id repeat from their first to their last window; they are known by one row each
and need no index. Among texts read together, a window that stands in several is settled there and then for all but the
smallest id, so that a passage in a third of all documents is a few rows to shuffle.

Defined results: ids are integers above -2**63, others are refused; null and empty texts have no words; a text shorter than
a window loses none; texts of any length are read whole; of repeated rows (same id) none is the earlier one; a null id is
neither earlier nor later than any, so it keeps its words; an empty table gives none; other columns come back inside
``doc``, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm._common import delete, fits_broadcast, materialize, shared_dir, written_once
from quarryline.llm.near_duplicates import text_key
from quarryline.llm.wordhash import ROLL, groups, run_hashes, running_min, within, word_hashes, words_of

WINDOW = 13
INNER = 6
FANOUT = 2
BATCHES = 3
#: The id that stands for all documents of earlier calls.
EARLIER = -(1 << 63)
#: Packed texts opened at a time, and windows of texts that are settled together.
PACKED = 256
TOGETHER = 300_000


def fingerprints(hashes: np.ndarray, window: int = WINDOW, inner: int = INNER) -> np.ndarray:
    """The fingerprint of each run of ``window`` words."""
    return running_min(run_hashes(hashes, inner), window - inner + 1)


def _signed(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([np.empty(0, dtype=np.uint64), *parts]).view(np.int64))


def _ints(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([np.empty(0, dtype=np.int64), *parts]).astype(np.int64))


def _stretches(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Windows of texts read together, as stretches that share a text and a fingerprint: (word hashes, first word of each text, starts of windows, first window of each stretch, fingerprints, texts)."""
    hashes, lens = word_hashes(texts)
    starts, which = within(lens, WINDOW, len(hashes))
    fps = fingerprints(hashes)[starts] if len(starts) else np.empty(0, dtype=np.uint64)
    first = np.flatnonzero(np.concatenate(([True], (fps[1:] != fps[:-1]) | (which[1:] != which[:-1])))) if len(fps) else np.empty(0, dtype=np.int64)
    return hashes, np.cumsum(lens) - lens, starts, first, fps[first], which[first]


def document_fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``fp, doc_id`` for the fingerprints of each document with an id, one for each stretch of windows that share it."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids = np.array(batch.column("doc_id").to_pylist(), dtype=np.int64)
            for first, texts in groups(batch.column("text")):
                *_, fps, which = _stretches(texts)
                yield pa.RecordBatch.from_arrays([_signed([fps]), _ints([ids[first + which]])], ["fp", "doc_id"])

    return rows.mapInArrow(batches, "fp long, doc_id long")


def bucketed(rows: DataFrame, table: str, path: str, buckets: int, by: str, sort: list[str] | None = None) -> None:
    """Writes rows that are dealt by ``by`` as a bucketed table of the session's catalog, whose files lie at ``path``."""
    writer = (rows.sortWithinPartitions(*sort) if sort else rows).write.option("path", path).bucketBy(buckets, by)
    with written_once(rows.sparkSession):
        (writer.sortBy(*sort) if sort else writer).saveAsTable(table)


class FingerprintIndex:
    """Sorted immutable runs of ``(fp, low, high)``, the documents of their fingerprints and, with ``texts``, their texts, below ``path`` (a folder that driver and executors share).

    ``add`` writes a batch as a run and gives what it matches; ``compact`` merges the runs of full levels; ``drop`` deletes
    the index. A new object on the ``path`` of an index that was kept goes on with it.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT, *, path: str | None = None, texts: bool = False):
        self.spark, self.fanout = spark, max(2, fanout)
        self.path = path or f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.name = f"fingerprints_{uuid.uuid4().hex}"
        self.buckets, self.texts = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), texts
        self.runs: list[tuple[int, int]] = []  # (level, number)
        self.batches: list[int] = []  # numbers of the batches whose documents are held
        self._made = self._state = 0
        if path:
            self._resume()

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}-{number}"

    def run(self, number: int) -> DataFrame:
        return self.spark.table(f"{self.name}_{number}")

    def _save(self) -> None:
        """Writes the list of runs under the next number; a folder counts once it is complete."""
        self._state += 1
        rows = [("run", level, number) for level, number in self.runs] + [("batch", 0, number) for number in self.batches] + [("buckets", 0, self.buckets), ("texts", 0, int(self.texts)), ("made", 0, self._made)]
        self.spark.createDataFrame(rows, "kind string, level int, number int").coalesce(1).write.json(self._folder("state", self._state))

    def _resume(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []
        states = [int(p.getName().split("-")[1]) for p in found if p.getName().startswith("state-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        if not states:
            return
        self._state = max(states)
        rows = self.spark.read.schema("kind string, level int, number int").json(self._folder("state", self._state)).collect()  # one row for each run
        one = {r["kind"]: r["number"] for r in rows}
        self.buckets, self.texts, self._made = one["buckets"], bool(one["texts"]), one["made"]
        self.runs, self.batches = sorted((r["level"], r["number"]) for r in rows if r["kind"] == "run"), sorted(r["number"] for r in rows if r["kind"] == "batch")
        for _, number in self.runs:
            self.spark.sql(f"CREATE TABLE {self.name}_{number} (fp BIGINT, low BIGINT, high BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self._folder('run', number)}'")

    def _write(self, rows: DataFrame, level: int) -> int:
        number, self._made = self._made, self._made + 1
        bucketed(rows, f"{self.name}_{number}", self._folder("run", number), self.buckets, "fp", ["fp"])
        self.runs.append((level, number))
        return number

    def add(self, rows: DataFrame, texts: DataFrame | None = None) -> tuple[int, DataFrame]:
        """Adds a batch ``fp, doc_id``, with its packed ``texts`` (doc_id, packed) if the index keeps them. Gives the batch's number and ``fp, before``: the fingerprints that two documents or more have, one of them in this batch, and the number of the latest run before the batch that has it (null for none)."""
        before = list(self.runs)
        number = self._made
        rows.write.parquet(self._folder("documents", number))
        held = self.documents([number])
        self._write(held.groupBy("fp").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).repartition(self.buckets, "fp"), 0)
        if self.texts and texts is not None:
            texts.write.parquet(self._folder("texts", number))
        self.batches.append(number)
        new = self.run(number)
        found = new.where("low < high").select("fp", F.lit(None).cast("int").alias("before"))
        for _, old in before:
            found = found.unionAll(new.select("fp").join(self.run(old).select("fp").hint("merge"), "fp", "left_semi").select("fp", F.lit(old).alias("before")))
        found = materialize(found, "matched")
        self._save()
        return number, found

    def documents(self, batches: list[int]) -> DataFrame:
        """``fp, doc_id`` of batches."""
        return self.spark.read.schema("fp long, doc_id long").parquet(*[self._folder("documents", n) for n in batches])

    def kept_texts(self, batches: list[int]) -> DataFrame:
        """``doc_id, text_hash, packed`` of batches."""
        return self.spark.read.schema("doc_id long, text_hash long, packed binary").parquet(*[self._folder("texts", n) for n in batches])

    def compact(self) -> None:
        """Merges the runs of each level that has ``fanout`` of them or more, bucket by bucket: outer merge joins of sorted buckets, whose rows stay in their buckets."""
        level = 0
        while any(x >= level for x, _ in self.runs):
            full = [number for x, number in self.runs if x == level]
            if len(full) >= self.fanout:
                merged = self.run(full[0])
                for number in full[1:]:
                    other = self.run(number).select(F.col("fp").alias("_fp"), F.col("low").alias("_low"), F.col("high").alias("_high"))
                    merged = merged.join(other.hint("merge"), F.col("fp") == F.col("_fp"), "full").select(F.coalesce("fp", "_fp").alias("fp"), F.least("low", "_low").alias("low"), F.greatest("high", "_high").alias("high"))
                self._write(merged, level + 1)
                self.runs = [r for r in self.runs if r[1] not in full]
                self._save()
                for number in full:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{number}")
                    delete(self.spark, self._folder("run", number))
            level += 1

    def drop(self) -> None:
        for _, number in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{number}")
        self.runs, self.batches = [], []
        delete(self.spark, self.path)


def packed(docs: DataFrame, text_col: str, keep: list) -> DataFrame:
    """``doc`` (a struct of ``keep``), ``text_hash`` and the text as zstd bytes (null for null): half of what a shuffle would move."""
    rows = docs.select(F.struct(*keep).alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=1)
        for batch in source:
            small = [None if t is None else shrink.compress(t.encode("utf-8", "surrogatepass")) for t in (v.as_py() for v in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text_hash"), pa.array(small, pa.binary())], ["doc", "text_hash", "packed"])

    return rows.mapInArrow(batches, T.StructType([rows.schema["doc"], T.StructField("text_hash", T.LongType()), T.StructField("packed", T.BinaryType())]))


def _unpacked(column: pa.Array) -> Iterator[str | None]:
    grow = zstandard.ZstdDecompressor()
    return (None if p is None else grow.decompress(p).decode("utf-8", "surrogatepass") for p in (v.as_py() for v in column))


def wanted_fingerprints(documents: DataFrame, matched: DataFrame) -> DataFrame:
    """``wanted_id, fps``: the matched fingerprints of each document. A fingerprint of many documents meets one row of ``matched``, so its side of the join can be split."""
    few = F.broadcast(matched) if fits_broadcast(matched) else matched
    return documents.join(few, "fp", "left_semi").groupBy(F.col("doc_id").alias("wanted_id")).agg(F.collect_set("fp").alias("fps"))


def matched_windows(texts: DataFrame, wanted: DataFrame, earlier: bool = False) -> DataFrame:
    """``h1, h2, doc_id, text_hash, at (places), settled`` of the windows of ``texts`` (doc_id, text_hash, packed) with a wanted fingerprint; documents of an ``earlier`` call are one.

    Of equal windows read together only those of the smallest id are sent to meet others by ``h1``, as one row for all
    their places; the rest are settled and need no meeting, so they are one row for each text, spread by its id.
    """
    joined = texts.join(wanted, F.col("doc_id") == F.col("wanted_id")).select((F.lit(EARLIER) if earlier else F.col("doc_id")).alias("id"), "text_hash", "packed", "fps")

    def told(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        one, two, doc, text, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(one)
        one, two, doc, text, at = one[order], two[order], doc[order], text[order], at[order]
        new = np.concatenate(([True], one[1:] != one[:-1]))
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        settled = (doc > np.minimum.reduceat(doc, first)[group]) & (np.minimum.reduceat(two, first) == np.maximum.reduceat(two, first))[group]
        one, two = np.where(settled, doc.astype(np.uint64) * np.uint64(ROLL[1]), one), np.where(settled, np.uint64(0), two)
        order = np.lexsort((text, doc, two, one, settled))  # places of one window, or settled ones, of one text side by side
        one, two, doc, text, at, settled = (x[order] for x in (one, two, doc, text, at, settled))
        begin = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (settled[1:] != settled[:-1]))))
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)).astype(np.int32)), pa.array(at.astype(np.int32)))
        return pa.RecordBatch.from_arrays([_signed([one[begin]]), _signed([two[begin]]), _ints([doc[begin]]), _ints([text[begin]]), lists, pa.array(settled[begin])], ["h1", "h2", "doc_id", "text_hash", "at", "settled"])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        for batch in source:
            ids, hashes_of = (np.array(batch.column(c).to_pylist(), dtype=np.int64) for c in ("id", "text_hash"))
            fps = batch.column("fps")
            for at in range(0, len(ids), PACKED):
                for k, texts in groups(list(_unpacked(batch.column("packed").slice(at, PACKED)))):
                    base = at + k
                    hashes, begin, starts, first, own, which = _stretches(texts)
                    if not len(first):
                        continue
                    spread = lambda row: row.astype(np.uint64) * np.uint64(ROLL[0])
                    lists = [np.asarray(fps[base + j].values) for j in range(len(texts))]
                    wanted_here = np.concatenate(lists).view(np.uint64) + spread(np.repeat(np.arange(len(texts)), [len(x) for x in lists]))
                    met = np.isin(own + spread(which), wanted_here)
                    lengths = np.diff(np.append(first, len(starts)))
                    keep = np.repeat(met, lengths)
                    if not keep.any():
                        continue
                    row, word = np.repeat(which, lengths)[keep], starts[keep]
                    second, _ = word_hashes(texts, 1)
                    found.append((run_hashes(hashes, WINDOW)[word], run_hashes(second, WINDOW, 1)[word], ids[base + row], hashes_of[base + row], word - begin[row]))
                    if sum(len(f[0]) for f in found) >= TOGETHER:
                        yield told(found)
                        found = []
        if found:
            yield told(found)

    return joined.mapInArrow(batches, "h1 long, h2 long, doc_id long, text_hash long, at array<int>, settled boolean")


def repeated_places(spark: SparkSession, windows: DataFrame, buckets: int) -> DataFrame:
    """``doc_id, text_hash, starts``: where windows start that also start in a document with a smaller id.

    Windows are dealt by ``h1`` once, into a bucketed table; the least id of each and the join with it need no shuffle.
    """
    name = f"windows_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    try:
        bucketed(windows.repartition(buckets, "h1"), name, path, buckets, "h1")
        held = spark.table(name)
        open_ = held.where("NOT settled")
        first = open_.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "low")
        same = (F.col("h1") == F.col("k1")) & (F.col("h2").bitwiseXOR(F.col("k2")) == 0)  # h2 is no join key, so that the buckets of h1 serve
        later = open_.join(first.hint("merge"), same & (F.col("doc_id") > F.col("low"))).select("doc_id", "text_hash", "at")
        told = later.unionAll(held.where("settled").select("doc_id", "text_hash", "at")).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("at")).alias("starts"))
        return materialize(told, "repeats")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)


def later_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``copy_id, copy_hash`` of texts that also stand, whole, under a smaller id."""
    keyed = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("copy_id"), F.xxhash64(text_col).alias("copy_hash"), text_key(F.col(text_col)).alias("key"))
    first = materialize(keyed.groupBy("key").agg(F.min("copy_id").alias("low"), F.max("copy_id").alias("high")).where("low < high").select("key", "low"), "copied")
    later = materialize(keyed.join(first, "key").where("copy_id > low").select("copy_id", "copy_hash"), "copies")  # nothing above the join needs a key's rows together, so a large group can be split
    return later.distinct()


def without_repeats(docs: DataFrame, id_col: str, text_col: str, repeats: DataFrame, keep: list[str], window: int = WINDOW) -> DataFrame:
    """``doc`` (a struct of the columns ``keep``), ``n_words, n_removed, kept`` (words joined by one space). ``repeats`` has ``starts``, null for a copy of a whole text."""
    rows = packed(docs, text_col, [F.struct(*keep).alias("row"), F.col(id_col).cast("long").alias("id")])
    marks = repeats.select("doc_id", F.col("text_hash").alias("hash"), "starts", F.col("starts").isNull().alias("whole"))
    joined = rows.join(marks, (F.col("doc.id") == F.col("doc_id")) & (F.col("text_hash") == F.col("hash")), "left").select(F.col("doc.row").alias("doc"), "packed", "starts", "whole")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            n_words, n_removed, kept = [], [], []
            starts = batch.column("starts")
            for k, (text, whole) in enumerate(zip(_unpacked(batch.column("packed")), batch.column("whole").to_pylist(), strict=True)):
                words = words_of(text)
                removed = 0
                if whole and len(words) >= window:
                    removed, left = len(words), []
                elif whole is False:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    places = np.unique(np.asarray(starts[k].values))
                    edge[places] += 1
                    edge[places + window] -= 1
                    covered = np.cumsum(edge[:-1]) > 0
                    removed = int(covered.sum())
                    left = [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]
                n_words.append(len(words))
                n_removed.append(removed)
                kept.append(b" ".join(left if removed else words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(batches, T.StructType([T.StructField("doc", joined.schema["doc"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """For each row ``doc, n_words, n_removed, kept``. Documents enter the index in ``batches`` by a hash of their ids. An ``index`` that is given must keep texts; its documents precede those of the call, which it holds afterwards."""
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col}: ids must be integers")
    if index is not None and not index.texts:
        raise ValueError("an index between calls must keep texts")
    held = index or FingerprintIndex(spark)
    history, old_runs = list(held.batches), {number for _, number in held.runs}
    copies = materialize(later_copies(docs, id_col, text_col), "copies")
    gone = F.broadcast(copies) if fits_broadcast(copies) else copies
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = own.join(gone, (F.col("doc_id") == F.col("copy_id")) & (F.xxhash64("text") == F.col("copy_hash")), "left_anti").where("doc_id IS NOT NULL")
    added, matched = [], None
    for k in range(batches):
        if index is None:  # of a kept index the runs of earlier calls are told apart until the call ends
            held.compact()
        batch = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k)
        number, found = held.add(document_fingerprints(batch, "doc_id", "text"), _texts_of(batch) if index is not None else None)
        added.append(number)
        matched = found if matched is None else matched.unionAll(found)
    wanted = materialize(wanted_fingerprints(held.documents(added), matched.select("fp").distinct()), "wanted")
    earlier = wanted_fingerprints(held.documents(history), matched.where(F.col("before").isin(old_runs)).select("fp").distinct()) if history else None
    if index is None:
        held.drop()  # the tables to come need the space
    windows = matched_windows(_texts_of(own), wanted)
    if history:
        windows = windows.unionAll(matched_windows(held.kept_texts(history), earlier, earlier=True))
    repeats = repeated_places(spark, windows, held.buckets).where(F.col("doc_id") != EARLIER)
    if index is not None:
        held.compact()
    marks = repeats.unionByName(copies.select(F.col("copy_id").alias("doc_id"), F.col("copy_hash").alias("text_hash"), F.lit(None).cast("array<int>").alias("starts")))
    return without_repeats(docs, id_col, text_col, marks, docs.columns if keep is None else keep)


def _texts_of(rows: DataFrame) -> DataFrame:
    return packed(rows, "text", ["doc_id"]).select("doc.doc_id", "text_hash", "packed")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(F.col("doc")[id_col].alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
