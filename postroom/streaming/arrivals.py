"""Counts of mail by the time it was sent, while it arrives out of order and more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(messages: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "1 hour", key: str = "guid") -> DataFrame:
    """(start, by, n): messages per window of their own time and value of ``by``.

    Over a stream the state is bounded by the watermark, ``late`` behind the newest time
    seen: a key delivered again within it counts once, a window is given once
    and for all when the watermark passes its end, and rows behind it are dropped, which the
    query's progress counts. Over a table it is the same without a watermark. Rows without a
    time are left out.
    """
    rows = messages.where(F.col(at).isNotNull()).select(key, at, by)
    if messages.isStreaming:
        rows = rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    else:
        rows = rows.dropDuplicates([key])
    return (
        rows.groupBy(F.window(at, width).alias("_window"), by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("_window.start").alias("start"), by, "n")
    )


def store_windows(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the windows that are complete, of all that has arrived since the last run, then stop."""
    return (
        counts.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark in a run that has ended."""
    return sum(
        operator["numRowsDroppedByWatermark"] for progress in query.recentProgress for operator in progress["stateOperators"]
    )
