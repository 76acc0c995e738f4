"""Token counts of whole texts: Arrow batches balanced by bytes, lengths only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import small_batches, text_of
from postroom.llm.encoding import byte_batches, encoder

LIMIT = 512


def _counting(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in byte_batches(batches, "text"):
            text = rows.column("text").combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").combine_chunks(),
                    pc.binary_length(text).cast(pa.int64()),
                    pa.array(encoder(path).lengths(text)),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return count


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs(doc_id, text, ...)``.

    Counts are those of the library for the vocabulary file at ``path``, for the
    whole text. A null text counts as empty and has 0 tokens; a null id, repeated
    ids and repeated rows stay as they are, row by row; other columns are ignored;
    an empty table gives an empty result. The file must lie at ``path`` on every
    executor. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    counted = rows.mapInArrow(_counting(path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
