"""What the operators of this subpackage share: the shared folder, written tables and size checks."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where that is unset (tests, one machine)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='quarryline-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def written_once(spark: SparkSession) -> Iterator[None]:
    """Within it Spark deletes the shuffle files of an execution when it ends, for what it wrote is read from then on."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage is cut at a table that every executor can read again, so a lost executor costs one read and no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with written_once(spark):
        df.write.parquet(path)
    _delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def stable(df: DataFrame) -> DataFrame:
    """A checkpoint: partitions and their rows stay what they are however often they are read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that a side may have to be broadcast; they are measured, not estimated.
BROADCAST_LIMIT = 16 << 20


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT) -> bool:
    """Whether all rows of ``df``, as UTF-8 JSON, are within ``limit`` bytes."""
    size = df.select(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long")).alias("n")).first()["n"]
    return (size or 0) <= limit


def rank_within(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Adds ``out``: the gapless rank from 0 of each row within its ``group``, in ``order``; equal rows get ranks in any order.

    Rows are dealt by range over group, order and a tie-breaker, so a group or a key of any size spreads over many tasks.
    A rank is the row's place in its task plus what earlier tasks hold of the group; that table has at most one row for
    each task and one for each group border, whatever the input.
    """
    keys = [group, *order]
    dealt = stable(df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie"))
    placed = dealt.withColumn("_at", F.monotonically_increasing_id()).withColumns({"_task": F.shiftright("_at", 33), "_pos": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    held = placed.groupBy(F.col(group).alias("_group"), F.col("_task").alias("_in")).agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    before = held.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_group").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    met = placed.join(F.broadcast(before), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_task") == F.col("_in")))
    return met.withColumn(out, F.col("_pos") - F.col("_first") + F.col("_before")).drop("_at", "_task", "_pos", "_group", "_in", "_n", "_first", "_before")


def broadcast_bytes(spark: SparkSession) -> int:
    """The session's own bound for a broadcast side, in bytes; 0 where broadcasts are off."""
    return max(0, int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()))
