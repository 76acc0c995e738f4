"""Size decisions: which tables may be broadcast, which inputs need spreading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What one broadcast may hold.
MAX_ROWS = 500_000
MAX_BYTES = 64 * 1024 * 1024


def broadcast_passes(
    dimension: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES
) -> int:
    """How many broadcasts a dimension needs, measured by one aggregate over it."""
    widths = [
        F.coalesce(F.octet_length(F.col(f"`{name}`").cast("string")), F.lit(0))
        for name in dimension.columns
    ]
    row = dimension.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(reduce(Column.__add__, widths)), F.lit(0)).alias("bytes"),
    ).first()
    return max(1, -(-row["rows"] // max_rows), -(-row["bytes"] // max_bytes))


def is_small(dimension: DataFrame) -> bool:
    """Does one broadcast hold it?

    If not, joins shuffle and adaptive execution splits their hot keys.
    """
    return broadcast_passes(dimension) == 1


def lookup(dimension: DataFrame, small: bool) -> DataFrame:
    """The dimension side of a join, broadcast only when it was measured small."""
    return F.broadcast(dimension) if small else dimension


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when an input is too small to fill one wave of scan tasks.

    A single small file arrives as one task however many cores wait. Rows are then
    dealt round in turn, by no key, so that what follows is planned exactly as over
    a large input; that one keeps its scan partitions.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size >= cores * split else df.repartition(2 * cores)


def _bytes(text: str) -> int:
    """A size setting such as ``128m`` or ``134217728b``."""
    units = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    number = text.lower().removesuffix("ib").removesuffix("b")
    digits = number.rstrip("kmgt")
    return int(digits) * units[number[len(digits) :]]


def require_unique(df: DataFrame, key: str) -> None:
    """Raise if a key stands in more than one row; only the largest count comes back."""
    most = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
    if (most or 0) > 1:
        raise ValueError(f"{key} must be unique, but a value of it stands in {most} rows")
