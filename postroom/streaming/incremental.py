"""Triage of messages as their files arrive.

A decision depends on one message only, so a stream is triaged batch by batch
with the same plan as a table, and keeps no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from postroom.operators.sizing import spread
from postroom.operators.triage import Rules, triage


def triage_stream(
    messages: DataFrame,
    rules: Rules,
    path: str,
    checkpoint: str,
    address_mode: str = "exact",
    score_mode: str = "count",
) -> StreamingQuery:
    """Decide what has arrived since the last run, then stop.

    Each batch overwrites its own folder, so a batch that is run again after a
    failure leaves its decisions once.
    """

    def decide(batch: DataFrame, batch_id: int) -> None:
        decided = triage(spread(batch), rules, address_mode, score_mode)
        decided.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        messages.writeStream.foreachBatch(decide)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
