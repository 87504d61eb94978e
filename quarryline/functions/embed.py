"""A deterministic hashing embedder: terms fall into cells with a sign, and the vector has length one."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import tokens

DIMENSIONS = 128


def embed(df: DataFrame, id_col: str, text_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """``id, embedding array<float>``; a text without terms is the zero vector. Term hashes are made by Spark, only the summing is Python, on Arrow batches."""
    held = df.select(F.col(id_col).alias("id"), F.coalesce(F.transform(tokens(F.col(text_col)), lambda t: F.xxhash64(t)), F.array().cast("array<bigint>")).alias("h"))

    def batches(source: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in source:
            lists = batch.column("h")
            counts = np.diff(np.asarray(lists.offsets))
            h = np.asarray(lists.flatten()).astype(np.int64)
            cells = np.zeros((len(counts), dimensions))
            row = np.repeat(np.arange(len(counts)), counts)
            np.add.at(cells, (row, h % dimensions), np.where((h >> 32) & 1, 1.0, -1.0))
            norm = np.linalg.norm(cells, axis=1, keepdims=True)
            flat = (cells / np.where(norm > 0, norm, 1)).astype(np.float32).ravel()
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dimensions), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("id"), vectors], ["id", "embedding"])

    return held.mapInArrow(batches, f"id {held.schema['id'].dataType.simpleString()}, embedding array<float>")
