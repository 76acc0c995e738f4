"""Connected components of links that no single machine need hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import written


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour is hung on the smallest of a node and its neighbours."""
    both = _both_ways(links)
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of them; ``b < a`` in every link."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    hung = links.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return hung.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def _digest(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
    ).first()
    return row["n"], row["x"]


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of ``links(a, b)`` the smallest node it is connected with.

    Large-star and small-star rounds in turn, until nothing changes; each round is
    written to the shared folder, so a lost executor costs one round at most. Loops,
    repeated links and both directions do no harm; without links the result is empty.
    """
    now = written(
        links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    before = None
    while (digest := _digest(now)) != before:
        before = digest
        now = written(_small_star(_large_star(now)), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
