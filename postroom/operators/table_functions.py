"""Predictors per organisation as Arrow table functions, called from SQL or over a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from postroom.operators.predict import BATCH, Predictor, answers
from postroom.operators.sizing import is_small, lookup

# Prompts of one organisation that one call of the function answers.
PART_ROWS = 50_000

_ANSWERS = pa.schema([(name, pa.string()) for name in ("organisation", "guid", "raw", "error")])
_RETURNS = "organisation string, guid string, raw string, error string"

OpenPredictor = Callable[[str | None], Predictor]


def predictor_function(open_predictor: OpenPredictor, batch: int = BATCH) -> UserDefinedTableFunction:
    """A table function (organisation, guid, raw, error) of a table (organisation, guid, prompt, ...).

    The table argument is partitioned by organisation, or by organisation and part (see
    ``parted``). ``open_predictor`` is called once per partition with the organisation and
    returns what answers up to ``batch`` prompts at a time; batches are full whatever
    the sizes in which rows arrive, so memory does not grow with the organisation.
    A prompt that fails yields its error and no answer; so does each prompt of an
    organisation whose predictor cannot be opened, and the others go on. Rows
    without an organisation are one more, named null. A missing column raises, and so
    does a partition of several organisations; other columns are ignored; an
    empty table gives no rows.
    """

    class Asked:
        def __init__(self) -> None:
            self.predictor: Predictor | None = None
            self.organisation: str | None = None
            self.waiting: list[tuple[str | None, str | None]] = []

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            missing = {"organisation", "guid", "prompt"} - set(rows.schema.names)
            if missing:
                raise ValueError(f"The table has no column {', '.join(sorted(missing))}")
            organisations = rows.column("organisation").unique().to_pylist()
            if self.predictor is None and organisations:
                self.organisation = organisations[0]
                self.predictor = self._opened(self.organisation)
            if any(o != self.organisation for o in organisations):
                raise ValueError("The table is not partitioned by organisation")
            columns = (rows.column(name).cast(pa.string()).to_pylist() for name in ("guid", "prompt"))
            self.waiting += zip(*columns, strict=True)
            full = len(self.waiting) // batch * batch
            for at in range(0, full, batch):
                yield self._answered(self.waiting[at : at + batch])
            self.waiting = self.waiting[full:]

        def terminate(self) -> Iterator[pa.Table]:
            if self.waiting:
                yield self._answered(self.waiting)

        @staticmethod
        def _opened(organisation: str | None) -> Predictor:
            try:
                return open_predictor(organisation)
            except Exception as failure:
                reason = failure
                return lambda prompts: [reason] * len(prompts)

        def _answered(self, asked: list[tuple[str | None, str | None]]) -> pa.Table:
            found = answers(self.predictor, [prompt for _, prompt in asked])
            failed = [isinstance(a, Exception) for a in found]
            columns = [
                [self.organisation] * len(asked),
                [guid for guid, _ in asked],
                [None if f else a for a, f in zip(found, failed, strict=True)],
                [str(a) if f else None for a, f in zip(found, failed, strict=True)],
            ]
            return pa.table([pa.array(c, pa.string()) for c in columns], schema=_ANSWERS)

    return F.arrow_udtf(Asked, returnType=_RETURNS)


def register_predictor(
    spark: SparkSession, name: str, open_predictor: OpenPredictor, batch: int = BATCH
) -> UserDefinedTableFunction:
    """Make a predictor callable from SQL.

    ``SELECT * FROM name(TABLE(asked) PARTITION BY (organisation, part))``
    """
    return spark.udtf.register(name, predictor_function(open_predictor, batch))


def parted(prompts: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """Add ``part`` to ``prompts(organisation, guid, prompt)``: an organisation's share of work.

    An organisation of up to ``rows`` prompts has one part, so its predictor is opened once; a
    larger one has as many parts as it takes, of prompts by the hash of their guid.
    Counts are combined before they are shuffled, and only those of large organisations, of
    which there are at most the prompts divided by ``rows``, come back to the prompts.
    """
    large = (
        prompts.groupBy(F.col("organisation").alias("_large"))
        .agg(F.ceil(F.count(F.lit(1)) / rows).alias("_parts"))
        .where("_parts > 1")
    )
    found = prompts.join(
        lookup(large, is_small(large)), F.col("organisation").eqNullSafe(F.col("_large")), "left"
    )
    part = F.pmod(F.xxhash64("guid"), F.coalesce("_parts", F.lit(1))).cast("int")
    return found.select(*prompts.columns, part.alias("part"))


def predict_by_organisation(
    prompts: DataFrame, open_predictor: OpenPredictor, batch: int = BATCH, rows: int = PART_ROWS
) -> DataFrame:
    """(organisation, guid, raw, error) for ``prompts(organisation, guid, prompt)``, as from SQL."""
    asked = parted(prompts.select("organisation", "guid", "prompt"), rows)
    return predictor_function(open_predictor, batch)(asked.asTable().partitionBy("organisation", "part"))
