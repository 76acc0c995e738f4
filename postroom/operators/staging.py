"""Results that several outputs share, written once."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Where staged tables go: ``spark.checkpoint.dir``, else a folder in the warehouse.

    Both are reached by every executor. Nothing is set in the session, and no
    folder of one machine is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/staging"
    return folder.rstrip("/")


class Staging:
    """Tables of one run below one folder, which can be dropped together."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.path = f"{(folder or shared_folder(spark)).rstrip('/')}/run-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """Write a result once and read it back, so that nothing upstream runs twice.

        Unlike a cache it outlives lost executors, and readers prune its columns.
        """
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete what this run staged; results that still read it are gone with it."""
        system, path = fs.FileSystem.from_uri(self.path.replace("s3a://", "s3://", 1))
        if system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)
