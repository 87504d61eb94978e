"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard scores a record by ``weight / -ln(u)``, where ``u`` in (0, 1) is a hash of key and shard; the highest score
wins, ties go to the lower shard number. A shard's score for a key depends on no other shard, so one more shard takes
records into itself and moves no others, and a larger weight only draws records in.

Defined results: a null key is the key of no other record; repeated keys share a shard; a null text has size 8 and the
checksum of no bytes; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm._common import materialize, rank_within

RECORD_OVERHEAD = 8


def _score(key: Column, shard: int, weight: float) -> Column:
    """(score, -shard), so that the greatest struct is the winner."""
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 8), 16, 10).cast("double")
    return F.struct((F.lit(float(weight)) / -F.log((h + 0.5) / F.lit(2.0**32))).alias("score"), F.lit(-shard).alias("order"))


def key_of(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("k"), column.cast("string")), F.lit("null"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to ``len(weights) - 1``, of a non-null string key. A weight of 0 takes no records."""
    if not weights or any(not (w >= 0 and math.isfinite(w)) for w in weights) or not any(weights):
        raise ValueError("weights must be finite, none below 0 and one above 0")
    scores = [_score(key, s, w) for s, w in enumerate(weights) if w > 0]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["order"]).cast("int")


def assign_shards(docs: DataFrame, weights: Sequence[float], *, id_col: str = "doc_id", text_col: str = "text", grown_weight: float = 1.0) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: the shard of each record, its place there, and its shard once one of ``grown_weight`` is added."""
    key = key_of(F.col(id_col))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + RECORD_OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, grown_weight]).alias("grown_shard"),
    )
    ranked = rank_within(materialize(keyed, "sharded"), "shard", ["doc_id", "text_crc32", "size"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
