"""From raw documents to packed sequences: quality rules, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last give the columns of docs, whatever these are besides doc_id and text, and whatever their
names; n_chars, where there is one, follows the text. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import decontamination, near_duplicates, packing, quality, secrets
from quarryline.llm._common import fits_broadcast, materialize, table

VOCABULARY = "byte_bpe_50k.json"


def _rows(told: DataFrame, columns: list[str], text: Column | None = None) -> DataFrame:
    """The rows in ``doc`` with the columns they came with; with ``text``, that is their text, and n_chars its length."""
    made = {} if text is None else {"text": text, "n_chars": F.length(text).cast("long")}
    return told.select(*(made.get(c, F.col("doc")[c]).alias(c) for c in columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that the rules reject go.

    Null and empty texts have no words and are rejected; repeated rows are judged alike; texts are judged whole.
    """
    return _rows(quality.judge_quality(docs).where("kept"), docs.columns, F.col("cleaned"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; of repeated rows one.

    Rows go by id and text, so that of one id with several texts only the copies go; a text that doesn't go by its id
    (see ``near_duplicates``) stays only in a group without one that does. Null ids and null texts are groups
    of their own and stay, as do empty texts but for copies of them; an empty table gives none.
    """
    told = near_duplicates.near_duplicate_groups(docs)[0].where("doc_id IS NOT NULL AND text_key IS NOT NULL AND (rep_id <> class_id OR n_copies > 1)")
    stays = (F.col("rep_id") == F.col("class_id")) & (F.col("doc_id") == F.col("first_id"))
    groups = materialize(told.groupBy("doc_id", "text_key").agg(F.bool_or(stays).alias("stays"), F.count("*").alias("n")), "groups")
    gone = groups.where("NOT stays").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    rows = docs.select(F.struct("*").alias("doc"), near_duplicates.text_key(F.col("text")).alias("key"))
    kept = rows.join(F.broadcast(gone) if fits_broadcast(gone) else gone, (F.col("doc.doc_id") == F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti")
    repeated = groups.where("stays AND n > 1").select(F.col("doc_id").alias("repeated_id"), F.col("text_key").alias("repeated_key"))
    same = (F.col("doc.doc_id") == F.col("repeated_id")) & (F.col("key") == F.col("repeated_key"))
    if not repeated.isEmpty():
        once = kept.join(repeated, same, "left_semi").withColumn("id", F.col("doc.doc_id")).dropDuplicates(["id", "key"]).drop("id")
        kept = kept.join(repeated, same, "left_anti").unionByName(once)
    return kept.select("doc.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay, as do null ids; repeated rows go or stay together; texts are read whole.
    """
    return _rows(decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0"), docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and no row goes.

    Null texts stay null; repeated rows are changed alike; texts are scanned whole.
    """
    return _rows(secrets.scan_secrets(docs), docs.columns, F.col("redacted"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence.

    Null and empty texts are the end id alone; repeated rows are packed each; long texts are cut into full windows and a rest.
    """
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Signatures, decoding and tokenization are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
