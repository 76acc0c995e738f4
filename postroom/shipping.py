"""Sending the package to the workers of a session."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()
_folders: list[tempfile.TemporaryDirectory] = []


def ship(spark: SparkSession) -> None:
    """Let workers import this package wherever they run; once per application.

    Predictors and Arrow functions are pickled by reference, so a worker needs the
    modules. An installed package, or one on the workers' path, needs no shipping.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(_PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
    # Spark's file server hands on this copy, which stays as long as the driver runs.
    folder = tempfile.TemporaryDirectory(prefix="postroom-")
    _folders.append(folder)
    path = os.path.join(folder.name, "postroom.zip")
    with open(path, "wb") as out:
        out.write(packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(application)
