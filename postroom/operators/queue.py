"""The backlog of unclassified messages, and merging predictions back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.operators.dimensions import UNCLASSIFIED
from postroom.operators.sizing import is_small, lookup


def is_unclassified() -> Column:
    open_ = F.col("predicted").isNull() | (F.col("predicted") == UNCLASSIFIED)
    return open_ & (F.col("body").isNotNull() | F.col("subject").isNotNull())


def work_queue(messages: DataFrame, n: int | None = None) -> DataFrame:
    """The unclassified messages; with ``n``, the newest ``n`` of them.

    Undated messages come last and equal dates are ordered by guid. Without
    ``n`` nothing is ordered, so the whole backlog streams from the scan.
    """
    waiting = messages.where(is_unclassified())
    if n is None:
        return waiting
    return waiting.orderBy(F.col("date").desc_nulls_last(), "guid").limit(n)


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """One prediction per guid of ``(guid, predicted, seq)``: the last written wins."""
    return predictions.groupBy("guid").agg(
        F.max_by("predicted", "seq").alias("new_predicted")
    )


def apply_predictions(
    messages: DataFrame,
    predictions: DataFrame,
    at: datetime | str,
    small: bool | None = None,
) -> DataFrame:
    """All messages, with ``predicted`` and ``predicted_date`` set where a guid matches.

    A batch of predictions that measures small is broadcast and the messages
    stay where they are; a larger one joins by shuffle.
    """
    small = is_small(predictions) if small is None else small
    new = lookup(latest_predictions(predictions).withColumn("hit", F.lit(True)), small)
    joined = messages.join(new, "guid", "left")
    changed = F.coalesce("hit", F.lit(False))
    return joined.select(
        *[
            F.when(changed, F.col("new_predicted")).otherwise(F.col(c)).alias(c)
            if c == "predicted"
            else F.when(changed, F.lit(at).cast("timestamp")).otherwise(F.col(c)).alias(c)
            if c == "predicted_date"
            else F.col(c)
            for c in messages.columns
        ]
    )


def log_predictions(predictions: DataFrame, at: datetime | str, path: str) -> None:
    """Append a batch of ``(guid, predicted, ...)`` to a log; nothing written before is touched.

    What a run moves is its batch, whatever the size of the message table.
    """
    stamped = latest_predictions(predictions).select(
        "guid", F.col("new_predicted").alias("predicted"), F.lit(at).cast("timestamp").alias("at")
    )
    stamped.write.mode("append").parquet(path)


def with_logged(messages: DataFrame, log: DataFrame, small: bool | None = None) -> DataFrame:
    """All messages as ``log(guid, predicted, at)`` leaves them; the latest entry counts."""
    latest = log.groupBy("guid").agg(
        F.max(F.struct("at", "predicted")).alias("last")
    ).select(F.col("guid").alias("logged"), "last.at", F.col("last.predicted").alias("new"))
    small = is_small(latest) if small is None else small
    latest = lookup(latest, small)
    joined = messages.join(latest, messages["guid"] == latest["logged"], "left")
    changed = F.col("logged").isNotNull()
    values = {"predicted": "new", "predicted_date": "at"}
    return joined.select(
        *[
            F.when(changed, F.col(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in messages.columns
        ]
    )


def write_predictions(
    messages: DataFrame,
    predictions: DataFrame,
    at: datetime | str,
    path: str,
    dry_run: bool = False,
) -> DataFrame:
    """Merge and write to a fresh path, which appears whole or not at all.

    This writes the whole table; ``log_predictions`` writes the batch alone. A dry
    run returns what would change, with whatever else is known of each prediction,
    and writes nothing.
    """
    if dry_run:
        rest = [c for c in predictions.columns if c not in ("guid", "predicted", "seq")]
        last = F.max(F.struct("seq", "predicted", *rest)).alias("last")
        return predictions.groupBy("guid").agg(last).select(
            "guid", *[F.col(f"last.{c}").alias(c) for c in ("predicted", *rest)]
        )
    apply_predictions(messages, predictions, at).write.mode("errorifexists").parquet(path)
    return messages.sparkSession.read.parquet(path)
