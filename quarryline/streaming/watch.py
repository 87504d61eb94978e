"""Streams: debounced change events, distinct paths, contents and an index kept up to date from a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarryline.functions.text import content_hash
from quarryline.plans.index import Index, apply_changes, build_index, from_tables
from quarryline.sources import folder as folders
from quarryline.sources.store import save, written
from quarryline.sources.versions import Store

DEBOUNCE = "500 milliseconds"
#: Paths that a watch leaves out: hidden ones and built ones.
UNWATCHED = r"(?:^|/)(?:\.[^/]+|node_modules|dist)(?:/|$)"


def watched(events: DataFrame, path: str = "path", depth: int = 10) -> DataFrame:
    return events.where(~F.col(path).rlike(UNWATCHED) & (F.size(F.split(path, "/")) <= depth + 1))


def debounced(events: DataFrame, *, key: str | None = None, ts: str = "ts", gap: str = DEBOUNCE, delay: str | None = "1 minute", path: str = "path") -> DataFrame:
    """Bursts: events no more than ``gap`` apart become one row ``start, end, n_events, paths``, by key if there is one. The same plan serves batches and streams."""
    held = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if held.isStreaming and delay:
        held = held.withWatermark(ts, delay)
    by = [F.session_window(ts, gap).alias("w"), F.col(key) if key else F.substring(path, 1, 0).alias("all")]  # a stream needs a key beside the window, and a constant is none
    told = held.groupBy(*by).agg(F.count("*").alias("n_events"), F.array_sort(F.collect_set(path)).alias("paths"))
    return told.select(*([key] if key else []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "paths")


def distinct_paths(events: DataFrame, *, path: str = "path", ts: str = "ts", delay: str = "1 minute") -> DataFrame:
    """Each path once within the delay."""
    if not events.isStreaming:
        return events.dropDuplicates([path])
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([path])


def file_stream(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """``file_path, content`` of files that appear below a folder."""
    held = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    return held.select(F.regexp_replace("path", "^file:/*", "/").alias("file_path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("ts"))


def apply_batch(state: DataFrame | None, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, changes): the latest version of each file in the batch against the state ``file_path, content, sha256``."""
    latest = batch.groupBy("file_path").agg(F.max_by("content", "ts").alias("content")).withColumn("sha256", content_hash(F.col("content")))
    if state is None:
        return latest, latest.select("file_path", F.lit("added").alias("status"))
    met = latest.join(state.select("file_path", F.col("sha256").alias("_old")), "file_path", "left")
    diff = met.select("file_path", F.when(F.col("_old").isNull(), "added").when(F.col("_old") == F.col("sha256"), "unchanged").otherwise("changed").alias("status"))
    return state.join(latest.select("file_path"), "file_path", "left_anti").unionByName(latest), diff


def watch_index(spark: SparkSession, folder: str, state_path: str, checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None, *, once: bool = False) -> StreamingQuery:
    """Keeps ``state_path/<version>`` as the latest contents below a folder. One batch at a time; a batch done twice gives the same state.

    A file source does not show deletions: compare a full listing with ``plans.index.changes`` now and then.
    """

    def each(batch: DataFrame, n: int) -> None:
        base = spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/{n - 1}")
        old = spark.read.parquet(f"{state_path}/{n - 1}") if n and base.getFileSystem(spark._jsc.hadoopConfiguration()).exists(base) else None
        state, diff = apply_batch(old, batch)
        save(state, f"{state_path}/{n}")
        if on_change:
            on_change(diff.where("status <> 'unchanged'"), n)

    writer = file_stream(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()


def changes_stream(spark: SparkSession, folder: str, listings: str, *, initial: bool = False, quiet: int = 500) -> DataFrame:
    """``file_path, event, modified, content`` of files that come, change and go below a folder (see ``sources.folder``)."""
    spark.dataSource.register(folders.FolderChanges)
    return spark.readStream.format(folders.NAME).option("path", folder).option("listings", listings).option("initial", str(initial)).option("quiet", quiet).load()


def apply_events(index: Index | None, events: DataFrame) -> tuple[Index, DataFrame]:
    """(index, changes) after events, one for each file; an event whose file has the content that the index knows changes nothing."""
    held = events.where("event = 'unlink' OR content IS NOT NULL")
    if index is None:
        fresh = held.where("event <> 'unlink'").select("file_path", "content")
        return build_index(fresh), fresh.select("file_path", F.lit("added").alias("status"))
    known = index.files.select("file_path", F.col("sha256").alias("_old"))
    status = F.when(F.col("event") == "unlink", F.when(F.col("_old").isNotNull(), "deleted").otherwise("unchanged")).when(F.col("_old").isNull(), "added").when(F.col("_old") == content_hash(F.col("content")), "unchanged").otherwise("changed")
    diff = written(held.join(known, "file_path", "left").select("file_path", status.alias("status")), "changes")
    fresh = held.join(diff.where("status IN ('added', 'changed')"), "file_path", "left_semi").select("file_path", "content")
    return apply_changes(index, diff, fresh), diff


def current(spark: SparkSession, root: str) -> Index | None:
    """The last version of an index that ``watch_code`` keeps; its files stay while the two versions after it are made."""
    held = Store(spark, root).tables()
    return from_tables(held) if held else None


def keep_index(spark: SparkSession, root: str, events: DataFrame, batch: str) -> DataFrame:
    """Brings the index below ``root`` up to date by events and gives the changes. Only the buckets of files that changed, or whose imports or calls meet other targets, are written; a batch that is done already changes nothing."""
    held = Store(spark, root)
    base = held.manifest()
    if base["note"] == batch:
        return events.select("file_path", F.lit("unchanged").alias("status")).limit(0)
    index, diff = apply_events(from_tables(held.tables()) if base["tables"] else None, events)
    with held.change(batch) as change:
        for name, table in index.stored().items():
            if name in change.tables:
                change.rewrite(name, table, index.rewritten[name])
            else:
                change.replace(name, table, "file_path")
    held.vacuum(3)
    return diff


def watch_code(spark: SparkSession, folder: str, root: str, checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None, *, once: bool = False, quiet: int = 500) -> StreamingQuery:
    """Keeps an index of a folder below ``root`` (see ``current``): files that come, change and go, in bursts that end with ``quiet`` milliseconds of rest, one after the other. ``on_change`` gets ``file_path, status`` of each burst."""

    def each(batch: DataFrame, n: int) -> None:
        events = written(batch, "events")
        diff = keep_index(spark, root, events, f"{checkpoint}#{n}").where("status <> 'unchanged'")
        if on_change:
            on_change(diff, n)

    writer = changes_stream(spark, folder, f"{checkpoint}/listings", initial=True, quiet=quiet).writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/stream")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()
