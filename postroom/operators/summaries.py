"""Reports at several levels at once, sketches that merge, and comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Registers of a sketch as a power of two; the error is about 1.04 / sqrt(registers), here 1.6 %.
SKETCH_BITS = 12


def rolled_up(rows: DataFrame, levels: list[str]) -> DataFrame:
    """(*levels, level, n, share): counts of rows at every level, from all (0) to the finest, in one aggregation.

    ``share`` is that of the next coarser group. A null that is a value of its own is
    told from one that stands for all by ``level``. Counts are combined before the shuffle.
    """
    counted = rows.rollup(*levels).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_grouped"))
    level = (F.lit(len(levels)) - F.bit_count("_grouped")).cast("int")
    counted = counted.select(*levels, level.alias("level"), "n")
    parents = [F.when(F.col("level") > i + 1, F.col(c)) for i, c in enumerate(levels[:-1])]
    siblings = Window.partitionBy("level", *parents)
    return counted.withColumn("share", F.col("n") / F.sum("n").over(siblings))


def sketches(rows: DataFrame, by: list[str], what: str, bits: int = SKETCH_BITS) -> DataFrame:
    """(*by, n, sketch): per group its rows and a sketch of its distinct ``what``, to be stored; nulls are left out of it."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(what), F.lit(bits)).alias("sketch"))


def merged(stored: DataFrame, by: list[str]) -> DataFrame:
    """(*by, n, distinct): stored sketches united to coarser groups; no row is read again."""
    return stored.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct")
    )


def compared_runs(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(*columns, gone, come, same): how often each row of two runs is in the first only, the second only, and both.

    Rows count as often as they stand there and nulls are equal, as in EXCEPT ALL
    and INTERSECT ALL, in one shuffle of counts that are combined before it.
    """
    runs = before.select(*columns, F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionByName(
        after.select(*columns, F.lit(0).alias("_b"), F.lit(1).alias("_a"))
    )
    b, a = F.col("_b"), F.col("_a")
    return (
        runs.groupBy(*columns)
        .agg(F.sum("_b").alias("_b"), F.sum("_a").alias("_a"))
        .select(
            *columns, F.greatest(b - a, F.lit(0)).alias("gone"), F.greatest(a - b, F.lit(0)).alias("come"), F.least(a, b).alias("same")
        )
    )


def changes_by(before: DataFrame, after: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, gone, come, same): the changes between two runs, added up per value of one of their columns."""
    return compared_runs(before, after, columns).groupBy(by).agg(*[F.sum(c).alias(c) for c in ("gone", "come", "same")])
