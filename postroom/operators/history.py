"""Messages, predictions and intents over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000


def as_of(moments: DataFrame, history: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """Each row of ``moments(key, at, ...)`` with the ``values`` of the last row of ``history(key, at, values)`` at or before it.

    Both sides go through one window by key, so no pair of a moment and an earlier row is
    formed, and a key's rows stream past. Of history rows at one time the one with the
    largest values counts. A moment before all history, or without key or time, gets nulls;
    history without key or time is left out. Moments are all kept, repeated ones too.
    """
    asked = moments.select(
        F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"),
        F.struct(*moments.columns).alias("_row"), F.lit(None).alias("_value"),
    )
    known = history.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(0).alias("_side"),
        F.lit(None).alias("_row"), F.struct(*values).alias("_value"),
    )
    so_far = (
        Window.partitionBy("_key").orderBy("_at", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        asked.unionByName(known)
        .withColumn("_value", F.last("_value", ignorenulls=True).over(so_far))
        .where("_side = 1")
        .select("_row.*", *[F.col(f"_value.{v}").alias(v) for v in values])
    )


def _bin(time: Column, width: Column) -> Column:
    return F.floor(time / width).cast("long")


def in_force(
    moments: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width: int = 60
) -> DataFrame:
    """Each pair of ``moments(keys, at, ...)`` and ``intervals(keys, start, end, ...)`` with start <= at < end.

    Time is cut into bins of ``width`` seconds, and into bins twice as long on every further
    level. An interval lies in two or three bins of the level of its own length, a moment in
    one bin of each level that occurs, so a pair meets in one bin alone, however long the
    interval. Other column names must differ. Rows without a key or time, and intervals that are empty or
    end before they begin, pair with nothing.
    """
    unit = width * SECOND
    since, until = F.unix_micros(F.col(start).cast("timestamp")), F.unix_micros(F.col(end).cast("timestamp"))
    level = F.greatest(F.ceil(F.log2((until - since) / unit)), F.lit(0)).cast("int")
    side = F.pow(F.lit(2.0), F.col("_level")) * unit
    placed = (
        intervals.where(F.col(start) < F.col(end))
        .withColumn("_level", level)
        .withColumn("_bin", F.explode(F.sequence(_bin(since, side), _bin(until - 1, side))))
    )
    # At most as many numbers as a time has bits.
    levels = sorted(r["_level"] for r in placed.select("_level").distinct().collect())
    asked = moments.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn(
        "_bin", _bin(F.unix_micros(F.col(at).cast("timestamp")), side)
    )
    met = asked.join(placed, [*keys, "_level", "_bin"])
    return met.where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_level", "_bin")


def _chunk(at: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (seconds * SECOND)).cast("long")


def threads(messages: DataFrame, sender: str, at: str, key: str, gap: int = 1_800, chunk: int = 86_400) -> DataFrame:
    """(key, sender, thread_no, place, since_previous, until_next): messages of a sender less than ``gap`` seconds apart are a thread.

    Threads count from 1 per sender, places from 1 per thread; gaps are in microseconds,
    null at either end. Equal times are ordered by key. Rows without sender or time are
    left out. A sender's time is cut into chunks of ``chunk`` seconds which are counted by
    themselves; what a chunk needs of those before it is one row, so no task holds a busy sender.
    """
    rows = messages.where(F.col(sender).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("key"), F.col(sender).alias("sender"),
        F.unix_micros(F.col(at).cast("timestamp")).alias("at"), _chunk(at, chunk).alias("chunk"),
    )
    within = Window.partitionBy("sender", "chunk").orderBy("at", "key")
    limit = gap * SECOND
    stepped = rows.withColumn("since", F.col("at") - F.lag("at").over(within)).withColumn(
        "later", F.lead("at").over(within) - F.col("at")
    )
    starts = F.when(F.col("since") >= limit, 1).otherwise(0)
    summed = stepped.groupBy("sender", "chunk").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.sum(starts).alias("starts"),
    )
    chunks = Window.partitionBy("sender").orderBy("chunk")
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.col("first") - F.lag("last").over(chunks)
    carried = (
        summed.withColumn("gap_before", apart)
        .withColumn("fresh", F.when(F.col("gap_before").isNull() | (F.col("gap_before") >= limit), 1).otherwise(0))
        .withColumn("gap_after", F.lead("first").over(chunks) - F.col("last"))
        .withColumn("threads_before", F.coalesce(F.sum(F.col("starts") + F.col("fresh")).over(before), F.lit(0)))
        .select("sender", "chunk", "gap_before", "gap_after", "fresh", "threads_before")
    )
    numbered = (
        stepped.withColumn("running", F.sum(starts).over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(carried, ["sender", "chunk"])
        .withColumn("thread_no", F.col("threads_before") + F.col("fresh") + F.col("running"))
        .withColumn("since_previous", F.coalesce("since", "gap_before"))
        .withColumn("until_next", F.coalesce("later", "gap_after"))
    )
    return _placed(numbered).select("key", "sender", "thread_no", "place", "since_previous", "until_next")


def _placed(numbered: DataFrame) -> DataFrame:
    """Places within a thread, which may run over several chunks: counted per chunk, then carried."""
    in_chunk = Window.partitionBy("sender", "chunk", "thread_no").orderBy("at", "key")
    parts = numbered.groupBy("sender", "chunk", "thread_no").agg(F.count(F.lit(1)).alias("n"))
    earlier = (
        Window.partitionBy("sender", "thread_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = parts.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return numbered.withColumn("in_chunk", F.row_number().over(in_chunk)).join(
        offsets, ["sender", "chunk", "thread_no"]
    ).withColumn("place", F.col("offset") + F.col("in_chunk"))


def moving_counts(messages: DataFrame, who: str, at: str, key: str, seconds: int = 3_600, chunks: int = 24) -> DataFrame:
    """(key, who, n): how many messages ``who`` got in the ``seconds`` up to each, itself and equal times included.

    A recipient's time is cut into chunks of so many times ``seconds``, and a message
    also goes to the chunk after its own if it still counts there; no task holds a busy
    recipient. Rows without recipient or time are left out.
    """
    size = seconds * chunks
    rows = messages.where(F.col(who).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("key"), F.col(who).alias("who"),
        F.unix_micros(F.col(at).cast("timestamp")).alias("at"), _chunk(at, size).alias("own"),
    )
    reaches = _bin(F.col("at") + seconds * SECOND, F.lit(size * SECOND))
    dealt = rows.withColumn("chunk", F.explode(F.sequence("own", reaches)))
    span = Window.partitionBy("who", "chunk").orderBy("at").rangeBetween(-seconds * SECOND, 0)
    return dealt.withColumn("n", F.count(F.lit(1)).over(span)).where("chunk = own").select("key", "who", "n")
