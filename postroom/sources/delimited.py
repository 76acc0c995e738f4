"""Delimited files whose cells may hold line ends, read in parallel.

A file is read as lines, by as many tasks as it has splits. Whether a line begins
inside a quoted cell depends on all lines before it, so each split first says how it
would leave either state: a map of two states, which is put together with those of
the splits before it by one row per split. Then each split knows the state it begins
in, and puts its lines together to records; a record that runs on into the next
splits is stitched from their lines by itself. Records are parsed by Spark's own parser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postroom.operators.sizing import lookup

# Where a reader can be in a line: where a cell begins, within a plain cell, within a
# quoted one, and behind a quote that ends it or is the first of a doubled one.
CELL, PLAIN, QUOTED, BEHIND = range(4)
# Splits whose states one broadcast holds, at some hundred bytes each.
MOST_SPLITS = 100_000
_SPLIT = "file string, block long, first long, last long, out_to boolean, in_to boolean, head long, tail_out long, tail_in long"


def _after_quote(state: Column) -> Column:
    return (
        F.when(state == CELL, QUOTED).when(state == QUOTED, BEHIND).when(state == BEHIND, QUOTED).otherwise(PLAIN)
    )


def _after_text(state: Column, text: Column, sep: str) -> Column:
    """Behind text without quotes."""
    return (
        F.when((text == "") | (state == QUOTED), state).when(F.endswith(text, F.lit(sep)), CELL).otherwise(PLAIN)
    )


def ends_quoted(line: Column, begins_quoted: bool, sep: str) -> Column:
    """Is the end of a line within a quoted cell, given what its beginning is?"""
    start = F.lit(QUOTED if begins_quoted else CELL)
    between = F.split(line, '"')
    state = F.aggregate(
        F.slice(between, F.lit(2), F.size(between)),
        _after_text(start, F.get(between, F.lit(0)), sep),
        lambda state, text: _after_text(_after_quote(state), text, sep),
    )
    return F.when(F.contains(line, F.lit('"')), state == QUOTED).otherwise(begins_quoted)


def _lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, block, no, line, out_to, in_to): every line with the number it has in its split."""
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("no"),
            F.col("value").alias("line"),
        )
        .select(
            "*",
            ends_quoted(F.col("line"), False, sep).alias("out_to"),
            ends_quoted(F.col("line"), True, sep).alias("in_to"),
        )
    )


def states_after(out_to: np.ndarray, in_to: np.ndarray, start: bool) -> np.ndarray:
    """The state behind each line, from the state before the first.

    A line that leads to one state from either settles it; others keep or swap it.
    """
    places = np.arange(len(out_to))
    settled = np.maximum.accumulate(np.where(out_to == in_to, places, -1))
    swaps = np.concatenate([[0], np.cumsum(out_to & ~in_to)])
    base = np.where(settled < 0, start, out_to[settled])
    return base ^ ((swaps[1:] - swaps[settled + 1]) % 2 == 1)


def _record_starts(after: np.ndarray, start: bool) -> np.ndarray:
    return ~np.concatenate([[start], after[:-1]])


def _summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: the state it leads to from either, and under either the lines that belong to other splits' records."""
    now: tuple | None = None

    def row() -> pa.RecordBatch:
        names = [part.split()[0] for part in _SPLIT.split(", ")]
        return pa.RecordBatch.from_pylist([dict(zip(names, now, strict=True))])

    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy()
        no = batch.column("no").to_numpy()
        out_to, in_to = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("out_to", "in_to"))
        cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (np.array(files[1:], object) != np.array(files[:-1], object))) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
            if a == b:
                continue
            if now is not None and now[:2] != (files[a], int(blocks[a])):
                yield row()
                now = None
            here = no[a:b]
            if now is None:
                now = (files[a], int(blocks[a]), int(here[0]), 0, False, True, -1, -1, -1)
            name, block, first, _, was_out, was_in, head, *tails = now
            ends, last = [], int(here[-1])
            for start, tail in ((was_out, tails[0]), (was_in, tails[1])):
                after = states_after(out_to[a:b], in_to[a:b], bool(start))
                begins = np.flatnonzero(_record_starts(after, bool(start)))
                ends.append((bool(after[-1]), int(here[begins[-1]]) if len(begins) else tail, begins))
            if head < 0 and len(ends[1][2]):
                head = int(here[ends[1][2][0]])
            now = (name, block, first, last, ends[0][0], ends[1][0], head, ends[0][1], ends[1][1])
    if now is not None:
        yield row()


def _splits(lines: DataFrame) -> DataFrame:
    """(file, block, first, head, tail, opened): per split where the record of an earlier one ends and where
    one that runs on begins, and how many such records began in earlier splits."""
    found = lines.select("file", "block", "no", "out_to", "in_to").mapInArrow(_summed_up, _SPLIT)
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    so_far = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    swaps = F.sum(F.when(F.col("out_to") & ~F.col("in_to"), 1).otherwise(0))
    odd = F.coalesce(F.col("swaps_before"), F.lit(0)) % 2 == 1
    settled = F.when(F.col("out_to") == F.col("in_to"), F.col("out_to") != (F.col("swaps") % 2 == 1))
    nowhere = F.col("last") + 1
    return (
        found.withColumn("swaps", swaps.over(so_far))
        .withColumn("swaps_before", swaps.over(before))
        .withColumn("settled", F.last(settled, ignorenulls=True).over(before))
        .withColumn("inside", F.coalesce("settled", F.lit(False)) != odd)
        .withColumn("head", F.when(~F.col("inside"), F.col("first")).when(F.col("head") < 0, nowhere).otherwise(F.col("head")))
        .withColumn("open", F.when(F.col("inside"), F.col("in_to")).otherwise(F.col("out_to")))
        .withColumn("tail", F.when(F.col("inside"), F.col("tail_in")).otherwise(F.col("tail_out")))
        .withColumn("tail", F.when(~F.col("open") | (F.col("tail") < 0), nowhere).otherwise(F.col("tail")))
        .withColumn("opened", F.coalesce(F.sum(F.when(F.col("tail") < nowhere, 1).otherwise(0)).over(before), F.lit(0)))
        .select(F.col("file").alias("_file"), F.col("block").alias("_block"), "first", "head", "tail", "opened")
    )


def _splits_at_most(lines: DataFrame) -> int:
    """A bound of the number of splits from the plan alone: a task reads one, or whole small files."""
    return lines.rdd.getNumPartitions() + len(lines.inputFiles())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, record): lines of whole records put together; ``head`` is true of a file's first one."""
    held: list[str] = []
    first = False
    for batch in batches:
        lines, tops = batch.column("line").to_pylist(), batch.column("top").to_pylist()
        out_to, in_to = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("out_to", "in_to"))
        after = states_after(out_to, in_to, bool(held))
        starts = _record_starts(after, bool(held))
        records, heads = [], []
        for line, top, start, inside in zip(lines, tops, starts.tolist(), after.tolist(), strict=True):
            if start:
                first = top
            if not inside and not held:
                records.append(line)
                heads.append(first)
                continue
            held.append(line)
            if not inside:
                records.append("\n".join(held))
                heads.append(first)
                held = []
        yield pa.RecordBatch.from_arrays([pa.array(heads, pa.bool_()), pa.array(records, pa.string())], names=["head", "record"])


def records(spark: SparkSession, path: str, sep: str = ",", small: bool | None = None) -> DataFrame:
    """(head, record): the text of every record below ``path``; lines end in ``\\n`` or ``\\r\\n``.

    The lines are read twice in parallel, first for their states alone, and once more
    for records over several splits. Who needs the records more than once stages them. Whatever such a record's size, only its own lines move.
    """
    lines = _lines(spark, path, sep)
    small = _splits_at_most(lines) <= MOST_SPLITS if small is None else small
    splits = lookup(_splits(lines), small)
    placed = lines.join(splits, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))).withColumn(
        "top", (F.col("block") == 0) & (F.col("no") == F.col("first"))
    )
    within = (F.col("no") >= F.col("head")) & (F.col("no") < F.col("tail"))
    inner = placed.where(within)
    if not small:
        # The shuffle has mixed the lines.
        inner = inner.sortWithinPartitions("file", "block", "no")
    whole = inner.select("line", "top", "out_to", "in_to").mapInArrow(_joined, "head boolean, record string")
    tail = F.when(F.col("no") >= F.col("tail"), 1).otherwise(0)
    over = (
        placed.where(~within)
        .groupBy("file", (F.col("opened") + tail).alias("record_no"))
        .agg(F.array_sort(F.collect_list(F.struct("block", "no", "line"))).alias("parts"), F.max("top").alias("head"))
        .select("head", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("record"))
    )
    # Without the byte order mark, and without the other half of a line end.
    plain = F.regexp_replace("record", "^﻿|\r$", "")
    return whole.unionByName(over).select("head", plain.alias("record")).where("record != ''")


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", small: bool | None = None) -> DataFrame:
    """The rows of delimited files with a head line each, parsed to ``schema``."""
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}
    parsed = F.from_csv("record", _ddl(schema), options)
    return records(spark, path, sep, small).where(~F.col("head")).select(parsed.alias("row")).select("row.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)

