"""The three batch jobs, end to end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.operators import matching, predict, prompts, queue, report, triage
from postroom.operators.dimensions import (
    labelled_intents,
    lexicon_from_json,
    lexicon_from_table,
    valid_codes,
)
from postroom.operators.predict import Predictor
from postroom.operators.sizing import require_unique, spread
from postroom.operators.staging import Staging
from postroom.sources import files


@dataclass(frozen=True)
class Outcome:
    """What a run leaves behind: rows to store, rows that failed, and its reports.

    They read staged tables; ``staging.drop()`` deletes those once all is stored.
    """

    results: DataFrame
    errors: DataFrame | None = None
    reports: dict[str, DataFrame] | None = None
    staging: Staging | None = None


def keyphrase_job(
    spark: SparkSession, input_path: str, lexicon_path: str, output_path: str | None = None,
    key: str | None = None, staging_folder: str | None = None,
) -> Outcome:
    """Add ``keyphrase_stats`` to a table of messages and write it to a fresh path.

    ``key`` names a unique column; repeated keys are an error. Without one the rows
    are numbered and staged first, since a running id must not be drawn twice. Delimited
    files are staged too, so that they are taken apart once. An output that overlaps the
    input is refused before anything is written.
    """
    output_path = output_path or files.enriched_path(input_path)
    files.refuse_overlap(input_path, output_path)
    staging = Staging(spark, staging_folder)
    table = files.read_table(spark, input_path)
    numbered = key is None
    if numbered:
        key = "_row"
        table = table.withColumn(key, F.monotonically_increasing_id())
    if numbered or files.is_delimited(input_path):
        table = staging.written(table, "input")
    if not numbered:
        require_unique(table.select(files.key_text(key).alias("key")), "key")
    lexicon = lexicon_from_json(files.read_lexicon_texts(spark, lexicon_path))
    messages = files.as_messages(table, key)
    counts = staging.written(matching.keyphrase_counts(messages, lexicon), "counts")
    stats = matching.keyphrase_json(messages, counts)
    stats = stats.withColumnRenamed("guid", "guid__")
    enriched = table.join(stats, files.key_text(key) == F.col("guid__"), "left").drop("guid__", "_row")
    files.write_enriched(enriched, output_path)
    return Outcome(
        counts,
        reports={"match_summary": report.match_summary(messages, counts, lexicon)},
        staging=staging,
    )


def rules_job(
    messages: DataFrame,
    lexicon_table: DataFrame,
    intent_table: DataFrame,
    n: int | None = None,
    address_mode: str = "exact",
    score_mode: str = "count",
    open_predictor: Callable[[], Predictor] | None = None,
    staging_folder: str | None = None,
    wording: prompts.Wording = prompts.DEFAULT,
) -> Outcome:
    """Decide the backlog by rule, and the rest by a predictor when one is given.

    Guids must be unique among the messages decided; repeated ones are an error.
    """
    staging = Staging(messages.sparkSession, staging_folder)
    rules = triage.Rules.load(lexicon_table, intent_table)
    waiting = queue.work_queue(messages, n)
    if n is not None:
        waiting = staging.written(waiting, "queue")
    require_unique(waiting, "guid")
    waiting = spread(waiting)
    if open_predictor is None:
        decided = staging.written(triage.triage(waiting, rules, address_mode, score_mode), "decided")
    else:
        decided = with_predictor(waiting, rules, open_predictor, address_mode, score_mode, staging, wording)
    return Outcome(
        decided,
        reports={
            "source_breakdown": report.source_breakdown(decided),
            "multi_intent": report.multi_intent(decided),
        },
        staging=staging,
    )


def with_predictor(
    waiting: DataFrame,
    rules: triage.Rules,
    open_predictor: Callable[[], Predictor],
    address_mode: str = "exact",
    score_mode: str = "count",
    staging: Staging | None = None,
    wording: prompts.Wording = prompts.DEFAULT,
) -> DataFrame:
    """Decisions, the unmatched ones answered by the predictor.

    Only the start of the text that a fallback prompt shows travels with the
    decisions, and only the unmatched keep it.
    """
    staging = staging or Staging(waiting.sparkSession)
    decided = triage.triage(
        waiting, rules, address_mode, score_mode, carry=prompts.fallback_text()
    )
    unmatched = F.col("match_source") == triage.UNMATCHED
    decided = staging.written(decided.withColumn("carried", F.when(unmatched, F.col("carried"))), "decided")
    rest = decided.where(unmatched)
    asked = spread(prompts.fallback_prompts(rest, rules.intents, wording))
    answers = staging.written(predict.predict(asked, open_predictor), "answers")
    answered = predict.parse_fallback(answers, rules.intents.select("intent_code"), rules.small)
    by_predictor = (
        rest.drop("final_intents", "match_source", "carried")
        .join(answered, "guid")
        .withColumn("match_source", F.lit(triage.FALLBACK))
    )
    return staging.written(
        decided.where(~unmatched).drop("carried").unionByName(by_predictor), "decisions"
    )


def predictor_job(
    messages: DataFrame,
    lexicon_table: DataFrame,
    intent_table: DataFrame,
    open_predictor: Callable[[], Predictor],
    organisation: str,
    n: int | None = None,
    staging_folder: str | None = None,
    wording: prompts.Wording = prompts.DEFAULT,
) -> Outcome:
    """Ask a predictor about the backlog, in the caller's ``wording``; keep failures apart.

    Guids must be unique among the messages asked about; repeated ones are an error.
    """
    staging = Staging(messages.sparkSession, staging_folder)
    lexicon, intents = lexicon_from_table(lexicon_table), labelled_intents(intent_table)
    context = prompts.context_block(lexicon, intents, organisation, wording)
    asked = prompts.full_prompts(queue.work_queue(messages, n), context, wording)
    if n is not None:
        asked = staging.written(asked, "prompts")
    require_unique(asked.select("guid"), "guid")
    answers = staging.written(predict.predict(spread(asked), open_predictor), "answers")
    parsed = predict.parse_responses(predict.predictions(answers), valid_codes(intents))
    predicted = parsed.select("guid", "predicted_intent", "predicted_code")
    return Outcome(
        predicted,
        predict.errors(answers),
        {
            "run_totals": report.run_totals(answers),
            "intent_distribution": report.intent_distribution(predicted),
        },
        staging,
    )


def store(
    messages: DataFrame, outcome: Outcome, at: datetime, path: str, dry_run: bool = False
) -> DataFrame:
    """Write an outcome's predictions back, by guid, to a fresh path.

    A dry run shows each prediction instead, with its source and confidence where
    rules made it.
    """
    results = outcome.results
    if "final_intents" in results.columns:
        predicted = triage.stored(results)
    else:
        predicted = results.select("guid", F.col("predicted_code").alias("predicted"))
    new = predicted.withColumn("seq", F.lit(0))
    return queue.write_predictions(messages, new, at, path, dry_run)
