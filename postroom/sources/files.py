"""Messages and dimensions in files."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postroom.sources.delimited import read_delimited

# Delimited-file cells that count as missing.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
SEPARATORS = {".csv": ",", ".tsv": "\t"}
# Stands for a missing key, which so finds its row again.
NO_KEY = "\0"
ENRICHED_SUFFIX = "_with_keyphrases.parquet"


def _stem(path: str) -> tuple[str, str]:
    """A path without its file's suffix, and the suffix; the path may be a URI."""
    path = path.rstrip("/")
    folder, slash, name = path.rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    return (folder + slash + stem, dot + suffix) if stem else (path, "")


def _suffix(path: str) -> str:
    return _stem(path)[1].lower()


def is_delimited(path: str) -> bool:
    return _suffix(path) in SEPARATORS


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    line_ends_in_cells: bool = True,
    one_task: bool = False,
) -> DataFrame:
    """Read parquet, csv or tsv by suffix; any other suffix is an error.

    Large delimited files are read in parallel, also where cells hold line ends; if
    none do, saying so spares a second pass. Cells that read as missing become null,
    and all columns are text unless a schema says otherwise. With ``one_task`` rows
    of a file keep their order.
    """
    suffix = _suffix(path)
    if suffix == ".parquet":
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if suffix not in SEPARATORS:
        raise ValueError(f"{path} is neither parquet nor {' nor '.join(SEPARATORS)}, but {suffix!r}")
    reader = spark.read.options(
        header=True, sep=SEPARATORS[suffix], multiLine=line_ends_in_cells, quote='"', escape='"'
    )
    if line_ends_in_cells and not one_task:
        # Only the first head line is read for the names.
        df = read_delimited(spark, path, schema or reader.csv(path).schema, SEPARATORS[suffix])
    else:
        df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(
        *[
            F.when(~_col(f.name).isin(MISSING), _col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else _col(f.name)
            for f in df.schema.fields
        ]
    )


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon or intent table with ``row_no`` as its place in the file.

    One file, read by one task, so the running id follows the rows.
    """
    df = read_table(spark, path, one_task=True).coalesce(1)
    if "row_no" in df.columns:
        return df.withColumn("row_no", F.col("row_no").cast("bigint"))
    return df.withColumn("row_no", F.monotonically_increasing_id() + 1)


def read_lexicon_texts(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, value): JSON lexicon files as whole texts, for ``lexicon_from_json``.

    Several files are numbered by their path.
    """
    place = F.row_number().over(W.orderBy("file"))
    return (
        spark.read.text(path, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("file"))
        .select((place - 1).cast("bigint").alias("row_no"), "value")
    )


def _col(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def resolve_message_columns(df: DataFrame) -> dict[str, str]:
    """Find the subject and body columns, whatever their case, blanks and brackets."""
    found = {}
    for wanted in ("subject", "body"):
        named = [name for name in df.columns if _plain_name(name) == wanted]
        if not named:
            raise ValueError(f"No column is named {wanted!r} among {df.columns}")
        found[wanted] = named[0]
    return found


def _plain_name(name: str) -> str:
    return "".join(c for c in name if c not in "[]").strip().casefold()


def key_text(key: str) -> Column:
    return F.coalesce(_col(key).cast("string"), F.lit(NO_KEY))


def as_messages(df: DataFrame, key: str, *more: str) -> DataFrame:
    """(guid, subject, body) of any table with a key column, and ``more`` of its columns.

    A missing key reads as NO_KEY.
    """
    found = resolve_message_columns(df)
    return df.select(
        key_text(key).alias("guid"),
        _col(found["subject"]).alias("subject"),
        _col(found["body"]).alias("body"),
        *[_col(name) for name in more],
    )


def write_bucketed(messages: DataFrame, table: str, buckets: int, path: str) -> None:
    """Save messages as a table bucketed by guid.

    Every result of the rules is gathered per guid, so over such a table they run
    without shuffling anything; worth it when the same mail is read repeatedly.
    """
    messages.write.option("path", path).bucketBy(buckets, "guid").sortBy("guid").saveAsTable(table)


def enriched_path(input_path: str) -> str:
    return _stem(input_path)[0] + ENRICHED_SUFFIX


def _place(path: str) -> str:
    """A path to compare: without scheme and host, without detours."""
    path = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path)
    return os.path.normpath(os.path.abspath(path)) + "/"


def refuse_overlap(input_path: str, output_path: str) -> None:
    """Raise if writing the output would touch the input: the same, inside, or above."""
    read, write = _place(input_path), _place(output_path)
    if read.startswith(write) or write.startswith(read):
        raise ValueError(f"The output {output_path} overlaps the input {input_path}; name a fresh path")


def write_enriched(df: DataFrame, path: str) -> None:
    """Parquet for a parquet path, otherwise csv; nested columns go to csv as JSON.

    The path must be fresh: nothing that exists is replaced.
    """
    if _suffix(path) == ".parquet":
        df.write.mode("errorifexists").parquet(path)
        return
    nested = (T.MapType, T.ArrayType, T.StructType)
    flat = df.select(
        *[
            F.to_json(_col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else _col(f.name)
            for f in df.schema.fields
        ]
    )
    flat.write.mode("errorifexists").options(
        header=True, quote='"', escape='"', sep=SEPARATORS.get(_suffix(path), ","),
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
