from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Ein langes Wort und noch eins, dann mehr.\n" * 4_000
UNBROKEN = "abcdefghij" * 20_000

# Nulls in any column, empty and very long texts, ties, repeated rows and repeated ids.
AWKWARD = [
    (None, None, None, None, None),
    (None, "a row without an id", "en", None, 1),
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, "  \n\t ", None, "a", 4),
    (4, "Hello big wide world of words", "en", "a", 29),
    (4, "Hello big wide world of words", "en", "a", 29),
    (4, "another text under the same id", "en", "a", 30),
    (5, "hello BIG wide world of words", "en", "b", 29),
    (6, LONG, "de", "b", len(LONG)),
    (7, LONG.upper(), "de", "b", len(LONG)),
    (8, UNBROKEN, "en", "b", len(UNBROKEN)),
    (9, "naïve—dash… “q”  double  spaces and　wide <|endoftext|> 1/2 ½ １２", "en", "c", 60),
]
# Names that operators use for columns of their own.
CLASHING = [
    "score", "held_out", "label", "n_tokens", "part", "hash", "content", "head", "bits", "version",
    "_version", "row", "key", "ids", "kept", "keep_id", "start", "length", "spans", "item_id", "count",
]


@pytest.fixture(scope="session")
def awkward(spark):
    schema = T.StructType.fromDDL(DOCS)
    for name in CLASHING:
        schema = schema.add(name, T.StringType())
    return spark.createDataFrame([row + ("x",) * len(CLASHING) for row in AWKWARD], schema)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
