"""A message table in buckets of which an update rewrites only those it touches.

Below ``path`` lie ``data/<version>/bucket=<b>`` with the messages, ``log/batch=<n>`` with
logged predictions, and ``manifest/version=<n>``: one small file that names, for each
bucket, the version that holds it, and the last batch of the log that is merged. The
newest manifest is the table. A change writes new data beside the old and then that one
file, whose rename is the swap: a run that dies before leaves the table as it was.
One writer at a time; readers hold on to the version they began with.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from postroom.operators.queue import apply_predictions, latest_predictions, with_logged

BUCKETS = 256
_MANIFEST = "bucket int, folder string, merged long, buckets int, ddl string, version long"
_LOG = "guid string, predicted string, at timestamp, batch long"


class BucketedTable:
    """The table below ``path``; every call reads the manifest anew."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, messages: DataFrame, path: str, buckets: int = BUCKETS) -> BucketedTable:
        """Write all messages to a fresh path. Guids must not be null."""
        table = cls(messages.sparkSession, path)
        if table._manifest():
            raise ValueError(f"There is a table at {path} already")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema.fields)
        folder = table._write(messages, buckets)
        table._swap([(b, folder) for b in range(buckets)], 0, buckets, ddl, 1)
        return table

    # Reading

    def read(self) -> DataFrame:
        """All messages of the newest version, logged predictions not yet merged included."""
        rows = self._manifest()
        merged = self._messages(rows)
        log = self._log(rows[0]["merged"])
        return merged if log is None else with_logged(merged, log.drop("batch"))

    def folders(self) -> dict[int, str]:
        """The folder that holds each bucket."""
        return {row["bucket"]: row["folder"] for row in self._manifest()}

    def _manifest(self) -> list:
        """The newest manifest: a row per bucket, bounded by their number."""
        try:
            rows = self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return []
            raise
        newest = rows.agg(F.max("version")).first()[0]
        return rows.where(F.col("version") == newest).orderBy("bucket").collect()

    def _messages(self, rows: list, only: set[int] | None = None) -> DataFrame:
        """The messages of some buckets, by default of all: one scan of the folders that hold them."""
        ddl = rows[0]["ddl"]
        held: dict[str, list[int]] = {}
        for row in rows:
            if only is None or row["bucket"] in only:
                held.setdefault(row["folder"], []).append(row["bucket"])
        found = None
        for folder, buckets in held.items():
            part = self.spark.read.schema(f"{ddl}, _bucket int").parquet(folder)
            part = part.where(F.col("_bucket").isin(buckets)).drop("_bucket")
            found = part if found is None else found.unionByName(part)
        return found if found is not None else self.spark.createDataFrame([], ddl)

    def _log(self, after: int) -> DataFrame | None:
        try:
            log = self.spark.read.schema(_LOG).parquet(f"{self.path}/log")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return None
            raise
        return log.where(F.col("batch") > after)

    # Writing

    def log(self, predictions: DataFrame, at: datetime | str) -> int:
        """Append a batch of ``(guid, predicted, seq)`` to the log, and give its number; no message is read."""
        done = self._manifest()[0]["merged"]
        log = self._log(done)
        number = 1 + max(done, (log.agg(F.max("batch")).first()[0] or 0) if log is not None else 0)
        latest_predictions(predictions).select(
            "guid", F.col("new_predicted").alias("predicted"), F.lit(at).cast("timestamp").alias("at")
        ).write.mode("errorifexists").parquet(f"{self.path}/log/batch={number}")
        return number

    def upsert(self, predictions: DataFrame, at: datetime | str) -> set[int]:
        """Merge a batch of ``(guid, predicted, seq)``; gives the buckets it rewrote.

        Predictions of guids that no message has change nothing. Merge the log first, so
        that batches count in the order they came in.
        """
        self.compact()
        rows = self._manifest()
        buckets = rows[0]["buckets"]
        touched = self._touched(predictions.select("guid"), buckets)
        old = self._messages(rows, touched)
        return self._replace(rows, touched, apply_predictions(old, predictions, at), rows[0]["merged"])

    def compact(self) -> set[int]:
        """Merge the log into the buckets it touches; gives those it rewrote."""
        rows = self._manifest()
        log = self._log(rows[0]["merged"])
        last = log.agg(F.max("batch")).first()[0] if log is not None else None
        if last is None:
            return set()
        log = log.where(F.col("batch") <= last)
        touched = self._touched(log.select("guid"), rows[0]["buckets"])
        return self._replace(rows, touched, with_logged(self._messages(rows, touched), log.drop("batch")), last)

    def vacuum(self) -> list[str]:
        """Delete what no reader of the newest version needs: folders without a bucket, merged batches, old manifests."""
        rows = self._manifest()
        system, root = fs.FileSystem.from_uri(self._uri(self.path))
        kept = {row["folder"].rsplit("/", 1)[1] for row in rows}
        kept |= {f"version={rows[0]['version']}"}
        gone = []
        for part in ("data", "log", "manifest"):
            for entry in system.get_file_info(fs.FileSelector(f"{root}/{part}", allow_not_found=True)):
                batch = entry.base_name.removeprefix("batch=")
                unmerged = part == "log" and (not batch.isdigit() or int(batch) > rows[0]["merged"])
                if entry.type == fs.FileType.Directory and entry.base_name not in kept and not unmerged:
                    system.delete_dir(entry.path)
                    gone.append(entry.path)
        return gone

    @staticmethod
    def _uri(path: str) -> str:
        return path.replace("s3a://", "s3://", 1)

    @staticmethod
    def _bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64("guid"), F.lit(buckets)).cast("int")

    def _touched(self, guids: DataFrame, buckets: int) -> set[int]:
        """At most as many numbers as there are buckets."""
        named = guids.where("guid IS NOT NULL").select(self._bucket(buckets).alias("b")).distinct()
        return {row["b"] for row in named.collect()}

    def _write(self, messages: DataFrame, buckets: int) -> str:
        """Write messages to a folder of their own, a folder per bucket in it."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        (
            messages.withColumn("_bucket", self._bucket(buckets))
            .repartition("_bucket")
            .write.mode("errorifexists")
            .partitionBy("_bucket")
            .parquet(folder)
        )
        return folder

    def _replace(self, rows: list, touched: set[int], messages: DataFrame, merged: int) -> set[int]:
        first = rows[0]
        folder = self._write(messages, first["buckets"]) if touched else None
        now = [(r["bucket"], folder if r["bucket"] in touched else r["folder"]) for r in rows]
        self._swap(now, merged, first["buckets"], first["ddl"], first["version"] + 1)
        return touched

    def _swap(self, held: list[tuple[int, str]], merged: int, buckets: int, ddl: str, version: int) -> None:
        rows = [(b, folder, merged, buckets, ddl) for b, folder in held]
        self.spark.createDataFrame(rows, "bucket int, folder string, merged long, buckets int, ddl string").coalesce(
            1
        ).write.mode("errorifexists").json(f"{self.path}/manifest/version={version}")
