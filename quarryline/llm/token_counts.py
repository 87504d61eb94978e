"""Token counts by rank-synchronous merging in ragged numpy arrays (see ``pretokens.MergeTable.count``).

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings inside a text count as the one token
that the library makes of them; texts and words of any length are counted whole, in n log n steps; rows are independent, so
repeated rows repeat their counts; an empty table gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.pretokens import counter

LIMIT = 512


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row; ``vocabulary`` is the path of a byte-level BPE file that every executor has."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(vocabulary)
        for batch in source:
            n_bytes: list[int] = []

            def texts(column: pa.Array, n_bytes: list[int] = n_bytes) -> Iterator[str]:
                for value in column:
                    text = value.as_py() or ""
                    n_bytes.append(len(text.encode()))
                    yield text

            n_tokens = [sum(sum(block) for block in blocks) for blocks in known.each(texts(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
