"""Messages in a SQL table.

A thin adapter over Spark's JDBC source: column list, filter and top-n go to
the server in one query. No database is available here, so only the text of
the query is tested; parquet is the tested path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns of the message table, and the backlog filter.
COLUMNS = ["GUID", "Date", "From", "To", "Subject", "Body"]
OPEN_ROWS = (
    "(Predicted IS NULL OR Predicted = 'Unclassified')"
    " AND (Body IS NOT NULL OR Subject IS NOT NULL)"
)
_QUOTES = {"sqlserver": ("[", "]"), "ansi": ('"', '"')}


def backlog_query(table: str, n: int | None = None, dialect: str = "sqlserver") -> str:
    left, right = _QUOTES[dialect]
    columns = ", ".join(f"{left}{c}{right} AS {left}{c.lower()}{right}" for c in COLUMNS)
    order = f" ORDER BY {left}Date{right} DESC"
    if n is None:
        return f"SELECT {columns} FROM {table} WHERE {OPEN_ROWS}"
    if dialect == "sqlserver":
        return f"SELECT TOP ({int(n)}) {columns} FROM {table} WHERE {OPEN_ROWS}{order}"
    return f"SELECT {columns} FROM {table} WHERE {OPEN_ROWS}{order} FETCH FIRST {int(n)} ROWS ONLY"


def read_backlog(
    spark: SparkSession,
    url: str,
    table: str,
    n: int | None = None,
    dialect: str = "sqlserver",
    **options: str,
) -> DataFrame:
    """The backlog, or its newest ``n``.

    Without ``n``, pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` to read in parallel; Spark then wants a ``dbtable``.
    """
    query = backlog_query(table, n, dialect)
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if "partitionColumn" in options:
        return reader.option("dbtable", f"({query}) backlog").load()
    return reader.option("query", query).load()


def append_predictions(stored, url: str, table: str, **options: str) -> None:
    """Append ``(guid, predicted, predicted_date)`` to a staging table.

    The server merges it into the message table by key in one statement of its own.
    """
    stored.write.format("jdbc").option("url", url).option("dbtable", table).options(
        **options
    ).mode("append").save()
