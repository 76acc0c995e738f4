"""What the operators over documents share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels of these documents are never learnt from.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """Is the document kept from learning? A null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: ``spark.checkpoint.dir``, else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/staging"
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Lists that note what is written, innermost last.
_noting: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """Paths that ``written`` makes meanwhile, in order."""
    paths: list[str] = []
    _noting.append(paths)
    try:
        yield paths
    finally:
        _noting.pop()


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more, wherever Spark can write."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back; it outlives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    for paths in _noting:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Let Spark close an Arrow batch by its bytes too, so that long texts do not pile up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 * 1024 * 1024))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents outside the held-out fold.

    Those with the smallest hash of their id are taken, so the choice depends on
    nothing else. The ids are at most ``most`` and are broadcast; only their texts move.
    """
    chosen = (
        labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each starts and the last ends); null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` that ``bounds`` part; empty runs give 0."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def kept_rows(docs: DataFrame, version: Column, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decided(doc_id, version, kept)`` keeps, each id and version once.

    What goes is usually little, so rows are matched with that; rows repeated as a
    whole are the only ones that are made distinct.
    """
    decided = written(decided, "decided")
    gone = decided.where(~F.col("kept")).select("doc_id", "version").distinct()
    repeated = decided.where("kept").groupBy("doc_id", "version").count().where("count > 1")
    keyed = docs.withColumn("_version", version)

    def same(other: DataFrame) -> Column:
        return keyed["doc_id"].eqNullSafe(other["doc_id"]) & (keyed["_version"] == other["version"])

    out = gone.unionByName(repeated.select("doc_id", "version"))
    single = keyed.join(out, same(out), "left_anti")
    once = keyed.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "_version"])
    return single.unionByName(once).select(*docs.columns)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 18) -> Iterator[pa.Table]:
    """Tables of a sorted stream that end where a run of equal keys ends."""
    held: list[pa.RecordBatch] = []
    rows, wanted = 0, most
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < wanted:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        found = changes(table, keys)
        if len(found) == 0:
            # One long run: looked at again once it has doubled.
            held, wanted = table.to_batches(), 2 * rows
            continue
        cut = int(found[-1])
        yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        rows, wanted = rows - cut, most
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows that begin a run, but for the first."""
    changed = np.zeros(max(0, table.num_rows - 1), bool)
    for key in keys:
        column = table.column(key).to_numpy()
        changed |= column[1:] != column[:-1]
    return np.flatnonzero(changed) + 1
