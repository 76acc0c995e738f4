"""Exact duplicates by sorting contents, in DataFrame operations only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import text_of, written

# A group with more than one in this many rows is hot; there are never more hot groups than that.
HOT_SHARE = 10_000
# Splitters are this many first characters and a hash: the driver samples no whole texts.
HEAD = 64
# A hot group's rows are gathered in lists of about this many ids.
LIST_IDS = 50_000


def normalised(text: Column) -> Column:
    """Only A to Z are lower-cased; every other byte stays."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(text.rlike("[A-Z]"), lowered).otherwise(text)


def _hot_contents(rows: DataFrame, total: int, share: int) -> DataFrame:
    """(hash, parts): contents that hold more than one in ``share`` rows; at most ``share`` hashes.

    The lists of a group are as many as its rows ask for.
    """
    counts = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where((F.col("n") > 1) & (F.col("n") * share > total))
    return hot.select("hash", F.greatest(F.lit(64), F.ceil(F.col("n") / LIST_IDS)).alias("parts"))


def content_groups(docs: DataFrame, keep: str = "largest", share: int = HOT_SHARE) -> DataFrame:
    """(keep_id, group_size, text_sha256, ids): one row per content and part of a hot group.

    Contents are range-partitioned by sampled splitters and sorted, so that equal
    ones meet as neighbours and are compared in full. Many texts may begin alike, so
    a hash follows the first characters in the splitters and in the order. A hot content is gathered
    where it is read first, one row per task and part, so that its copies do not
    all travel; the parts of one hot content share length and SHA-256.
    """
    best = {"largest": F.max, "smallest": F.min}[keep]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(text_of()).alias("content"))
    hashed = rows.withColumn("hash", F.xxhash64("content"))
    hot = F.broadcast(written(_hot_contents(hashed.select("hash"), docs.count(), share), "hot"))
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    gathered = (
        F.count(F.lit(1)).alias("n"),
        best("doc_id").alias("best"),
        F.collect_list(F.struct("doc_id")).alias("ids"),
    )
    digest = F.sha2(F.col("content"), 256).alias("text_sha256")
    size = F.octet_length("content").alias("n_bytes")
    pre_gathered = (
        hashed.join(hot, "hash")
        .groupBy("content", part.alias("part"))
        .agg(*gathered)
        .select(digest, size, "n", "best", "ids", F.lit(True).alias("hot"))
    )
    order = ["head", "hash", "content"]
    sorted_contents = (
        hashed.join(hot, "hash", "left_anti")
        .select(F.substring("content", 1, HEAD).alias("head"), "hash", "content", "doc_id")
        .repartitionByRange("head", "hash")
        .sortWithinPartitions(*order, "doc_id")
    )
    neighbours = (
        sorted_contents.groupBy(*order)
        .agg(*gathered)
        .select(digest, size, "n", "best", "ids", F.lit(False).alias("hot"))
    )
    groups = written(neighbours.unionByName(pre_gathered), "contents")
    # At most ``share`` hot contents, so this side is bounded.
    totals = (
        groups.where("hot")
        .groupBy("text_sha256", "n_bytes")
        .agg(F.sum("n").alias("total"), best("best").alias("of_all"))
    )
    return groups.join(F.broadcast(totals), ["text_sha256", "n_bytes"], "left").select(
        F.coalesce("of_all", "best").alias("keep_id"),
        F.coalesce("total", "n").alias("group_size"),
        "text_sha256",
        "ids",
    )


def exact_duplicates(docs: DataFrame, keep: str = "largest", share: int = HOT_SHARE) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs(doc_id, text, ...)``.

    Texts are equal when they are the same bytes after lower-casing A to Z alone.
    A null text counts as empty, and all empty texts are one group. Rows with the
    same id are rows of their own in ``group_size``; each of them has
    ``kept`` when its id is the one kept. A row without an id never stays where a
    row with one does; a group without any id has a null ``keep_id`` and is kept.
    Other columns are ignored; an empty table gives an empty result.
    """
    groups = content_groups(docs, keep, share)
    return groups.select(
        F.explode("ids").alias("row"), "keep_id", "group_size", "text_sha256"
    ).select(
        F.col("row.doc_id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("row.doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def kept_of_equal(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """(doc_id, version, kept): as ``exact_duplicates``, by id and normalised content."""
    return exact_duplicates(docs, keep).select("doc_id", F.col("text_sha256").alias("version"), "kept")
