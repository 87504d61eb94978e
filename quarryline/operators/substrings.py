"""Texts that hold a string, by trigrams: postings of the texts' pieces of three characters, and exact verification.

A string stands in a text only if all its trigrams do, so of each string the one that fewest texts have decides which texts
are looked at: pieces are counted, where they are met, and only the rarest are listed. Strings of one or two characters are pieces themselves, the empty one is a piece of every text. All joins are
on pieces, and a common piece is one row for each text that has it, so that its side can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.sources.store import written

SIZE = 3


def pieces(text: Column, size: int = SIZE) -> Column:
    """The distinct pieces of ``size`` characters of a text, in one pass; none of a shorter one."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def postings(texts: DataFrame, id_col: str, text_col: str, sizes: list[int] | None = None) -> DataFrame:
    """``piece, id``: which texts have a piece; without ``sizes`` pieces of three characters alone."""
    found = F.concat(*[F.array(F.lit("")) if n == 0 else pieces(F.col(text_col), n) for n in sizes or [SIZE]])
    return texts.where(F.col(text_col).isNotNull()).select(F.explode(found).alias("piece"), F.col(id_col).alias("id"))


def contained(texts: DataFrame, text_col: str, needles: DataFrame, needle_col: str) -> DataFrame:
    """``needle, text``: each needle with each distinct text that holds it. Null holds nothing and is in nothing."""
    held = texts.select(F.col(text_col).alias("text")).where("text IS NOT NULL").distinct().withColumn("id", F.xxhash64("text"))  # texts of one hash are told apart by the last step
    wanted = written(needles.select(F.col(needle_col).alias("needle")).where("needle IS NOT NULL").distinct(), "needles")
    sizes = sorted(r["n"] for r in wanted.select(F.least(F.length("needle"), F.lit(SIZE)).alias("n")).distinct().collect())  # 0 to 3
    if not sizes:
        return wanted.select("needle", F.col("needle").alias("text"))
    keys = wanted.select("needle", F.explode(F.when(F.length("needle") < SIZE, F.array("needle")).otherwise(pieces(F.col("needle")))).alias("piece"))
    found = postings(held, "id", "text", sizes)
    counts = found.join(keys.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    fewest = keys.join(counts, "piece", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("p"))
    rarest = written(fewest.where("p.n > 0").select("needle", F.col("p.piece").alias("piece")), "rarest")
    return found.join(rarest, "piece").join(held, "id").where(F.contains("text", "needle")).select("needle", "text")


def save_postings(texts: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """The trigrams of texts as a table sorted by piece, in lower case, so that a lookup reads the few row groups that hold its pieces."""
    rows = postings(texts.select(id_col, F.lower(text_col).alias(text_col)), id_col, text_col)
    rows.repartitionByRange("piece", "id").sortWithinPartitions("piece", "id").write.mode("overwrite").parquet(path)


def lookup(index: DataFrame, pattern: str) -> DataFrame:
    """``id`` of the texts that have all trigrams of a pattern in any case, the only ones that can hold it. A pattern of under three characters has none; look at all texts then."""
    low = pattern.lower()
    wanted = sorted({low[k : k + SIZE] for k in range(len(low) - SIZE + 1)})
    if not wanted:
        raise ValueError("a pattern of three characters or more")
    return index.where(F.col("piece").isin(wanted)).groupBy("id").agg(F.count_distinct("piece").alias("n")).where(F.col("n") == len(wanted)).select("id")
