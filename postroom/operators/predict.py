"""Running a caller's predictor over prompts, and checking what it answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.functions.text import strip_blanks
from postroom.operators.dimensions import UNCLASSIFIED
from postroom.operators.sizing import is_small, lookup

# Fixed value: the part of an answer that is read as JSON.
JSON_PART = r"\{[^{}]+\}"

# Prompts that a predictor gets at a time.
BATCH = 64

_STRICT = {"allowSingleQuotes": "false"}

# Answers a list of prompts: for each its answer, or the exception that it failed with.
Predictor = Callable[[list[str]], list]


def one_by_one(answer: Callable[[str], str]) -> Predictor:
    """A predictor from a function that answers one prompt."""

    def answer_all(prompts: list[str]) -> list:
        found: list = []
        for prompt in prompts:
            try:
                found.append(answer(prompt))
            except Exception as failure:
                found.append(failure)
        return found

    return answer_all


def answers(predictor: Predictor, prompts: list[str]) -> list:
    """Answers of a batch; if it fails as a whole, of its prompts one at a time."""
    try:
        found = list(predictor(prompts))
        if len(found) != len(prompts):
            raise ValueError(f"{len(found)} answers to {len(prompts)} prompts")
        return found
    except Exception as failure:
        if len(prompts) == 1:
            return [failure]
        return [answer for prompt in prompts for answer in answers(predictor, [prompt])]


def predict(
    prompts: DataFrame, open_predictor: Callable[[], Predictor], batch: int = BATCH
) -> DataFrame:
    """(guid, raw, error) for ``prompts(guid, prompt)``.

    ``open_predictor`` is called once per task and returns the function that
    answers up to ``batch`` prompts at a time. A prompt that fails yields its error
    and no answer, and the others go on. Spread a short queue over the cluster
    before this.
    """

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = open_predictor()
        for rows in batches:
            for at in range(0, len(rows), batch):
                some = rows.iloc[at : at + batch]
                found = answers(predictor, some["prompt"].tolist())
                failed = [isinstance(a, Exception) for a in found]
                yield pd.DataFrame(
                    {
                        "guid": some["guid"].tolist(),
                        "raw": [None if f else a for a, f in zip(found, failed, strict=True)],
                        "error": [str(a) if f else None for a, f in zip(found, failed, strict=True)],
                    }
                )

    return prompts.select("guid", "prompt").mapInPandas(
        answer, "guid string, raw string, error string"
    )


def _as_text(members: Column, typed: Column, name: str) -> Column:
    """A JSON member as text: empty when missing, ``None`` for a null, ``True`` for true.

    Of repeated members the last counts. ``typed`` tells true from "true".
    """
    last = F.try_element_at(
        F.filter(F.map_entries(members), lambda e: e["key"] == name), F.lit(-1)
    )
    kind = F.schema_of_variant(F.try_variant_get(typed, f"$.{name}", "variant"))
    return strip_blanks(
        F.when(last.isNull(), "")
        .when(last["value"].isNull(), "None")
        .when(kind == "BOOLEAN", F.initcap(last["value"]))
        .otherwise(last["value"])
    )


def parse_responses(
    responses: DataFrame, codes: DataFrame, small: bool | None = None
) -> DataFrame:
    """Add (predicted_intent, predicted_code) to ``responses(..., raw)``.

    The first braced part must be JSON and its code one of ``codes(intent_code)``:
    as written, else the first in order that differs only in case. Anything else
    is unclassified.
    """
    small = is_small(codes) if small is None else small
    spellings = (
        codes.select("intent_code").distinct()
        .groupBy(F.lower("intent_code").alias("lowered"))
        .agg(F.array_sort(F.collect_list("intent_code")).alias("allowed"))
    )
    part = F.regexp_extract("raw", JSON_PART, 0)
    read = responses.withColumn("_members", F.from_json(part, "map<string,string>", _STRICT)).withColumn(
        "_typed", F.try_parse_json(part)
    )
    # The members are null when the part is no JSON, and then nothing matches.
    code, label = (_as_text(F.col("_members"), F.col("_typed"), n) for n in ("intent_code", "intent"))
    valid = F.col("_members").isNotNull()
    read = read.select(
        *responses.columns, F.when(valid, code).alias("_code"), F.when(valid, label).alias("_intent")
    )
    joined = read.join(
        lookup(spellings, small), F.lower(F.col("_code")) == F.col("lowered"), "left"
    )
    code = F.when(F.array_contains("allowed", F.col("_code")), F.col("_code")).otherwise(
        F.get("allowed", F.lit(0))
    )
    known = F.col("allowed").isNotNull()
    return joined.select(
        *responses.columns,
        F.when(known, F.col("_intent")).otherwise(UNCLASSIFIED).alias("predicted_intent"),
        F.when(known, code).otherwise(UNCLASSIFIED).alias("predicted_code"),
    )


def parse_fallback(responses: DataFrame, codes: DataFrame, small: bool | None = None) -> DataFrame:
    """(guid, final_intents) of ``responses(guid, raw)``: the allowed codes, repeats kept.

    No allowed code, or no readable answer, is unclassified.
    """
    small = is_small(codes) if small is None else small
    read = F.from_json(
        F.regexp_extract("raw", JSON_PART, 0), "intent_codes array<string>", _STRICT
    )
    listed = responses.select("guid", F.posexplode_outer(read["intent_codes"]).alias("place", "code"))
    allowed = lookup(codes.select(F.col("intent_code").alias("code"), F.lit(True).alias("ok")).distinct(), small)
    kept = F.collect_list(F.when(F.col("ok"), F.struct("place", "code")))
    return (
        listed.join(allowed, "code", "left")
        .groupBy("guid")
        .agg(F.transform(F.array_sort(kept), lambda c: c["code"]).alias("kept"))
        .select(
            "guid",
            F.when(F.size("kept") > 0, F.col("kept"))
            .otherwise(F.array(F.lit(UNCLASSIFIED)))
            .alias("final_intents"),
        )
    )


def predictions(outcomes: DataFrame) -> DataFrame:
    """The rows that may be written back."""
    return outcomes.where(F.col("error").isNull())


def errors(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("error").isNotNull()).select("guid", "error")
