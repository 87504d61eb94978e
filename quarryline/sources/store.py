"""Tables on storage: the shared folder for intermediate ones, overwrite, upsert, cascade delete."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='quarryline-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back; loops cut their lineage with it. Deleted when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` as a written table with ``_part``, the number of a range of ``keys``: parts in order hold the rows in order.

    Rows of equal keys share a part. The table is written, so that a row's part doesn't change when a task is repeated.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), "ranged")


def numbered(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """``df`` with the place of each row in the order of ``keys``, from 0 on. Rows are counted within ranges, and only the ranges' counts are added up in one task."""
    held = ranged(df, *keys)
    counts = held.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    begins = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begin"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return held.withColumn("_row", within).join(F.broadcast(begins), "_part").withColumn(name, F.col("_begin") + F.col("_row") - 1).drop("_part", "_row", "_begin")


def save(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """The whole table, in place of what was there."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a saved index by name; missing ones are left out."""
    found = {}
    for name in ("files", "symbols", "imports", "chunks", "edges", "terms", "links", "git_churn", "cochange", "communities"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            found[name] = spark.read.parquet(f"{root}/{name}")
    return found


def registry(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Files with the names that they export and the targets that they import, in the order of parsing."""
    ordered = lambda seq, value, name: F.transform(F.array_sort(F.collect_list(F.struct(seq, value))), lambda x: x[value]).alias(name)
    exports = symbols.where("is_exported").groupBy("file_path").agg(ordered("parse_seq", "name", "exports"))
    targets = imports.groupBy("file_path").agg(ordered("parse_seq", "target", "imports"))
    empty = F.array().cast("array<string>")
    return files.join(exports, "file_path", "left").join(targets, "file_path", "left").withColumns({"exports": F.coalesce("exports", empty), "imports": F.coalesce("imports", empty)})


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """One row for each key: the new one, of several new ones that with the greatest ``version``."""
    latest = new
    if version:
        others = [c for c in new.columns if c not in keys]
        latest = new.groupBy(*keys).agg(F.max_by(F.struct(*others), version).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in others]).select(*new.columns)
    else:
        latest = new.dropDuplicates(keys)
    return stored.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def delete_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of the files in ``gone``; edges by the file of their source."""
    keys = gone.select("file_path").distinct()
    out = {}
    for name, t in tables.items():
        if name == "edges":
            out[name] = t.withColumn("_f", F.substring_index("src", "#", 1)).join(keys.withColumnRenamed("file_path", "_f"), "_f", "left_anti").drop("_f")
        elif name == "cochange":
            out[name] = t.join(keys.withColumnRenamed("file_path", "file_a"), "file_a", "left_anti").join(keys.withColumnRenamed("file_path", "file_b"), "file_b", "left_anti")
        else:
            out[name] = t.join(keys, "file_path", "left_anti")
    return out
