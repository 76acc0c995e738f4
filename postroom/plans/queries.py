"""One named query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.functions import text
from postroom.operators import dimensions, history, matching, predict, prompts, queue, report, summaries, table_functions, triage
from postroom.operators.sizing import spread
from postroom.operators.staging import Staging
from postroom.operators.versioned import BucketedTable
from postroom.plans import fixtures, jobs
from postroom.sources import files
from postroom.streaming import arrivals

Query = Callable[[SparkSession, str], DataFrame]
PREDICTED_AT = "2024-06-01 12:00:00"
ORGANISATION = "a utility company"
QUEUE_LENGTH = 100

_QUERIES: dict[str, Query] = {}


def query(run: Query, name: str | None = None) -> Query:
    _QUERIES[name or run.__name__] = run
    return run


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _rules(spark: SparkSession) -> triage.Rules:
    return triage.Rules.load(fixtures.lexicon_table(spark), fixtures.intent_table(spark))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark).hits(fixtures.messages(spark, sf_dir))


def _keyphrase_lexicon(spark: SparkSession) -> DataFrame:
    return dimensions.lexicon_from_table(fixtures.lexicon_table(spark))


def _labelled(spark: SparkSession) -> DataFrame:
    return dimensions.labelled_intents(fixtures.intent_table(spark))


def _texts(spark: SparkSession, sf_dir: str, name: str, key: str, col: str) -> DataFrame:
    df = fixtures.table(spark, sf_dir, name)
    return spread(df.select(F.col(key).alias("id"), F.col(col).alias("text")))


def _step(spark: SparkSession, sf_dir: str, name: str, key: str, col: str,
          step: Callable[[Column], Column]) -> DataFrame:
    return _texts(spark, sf_dir, name, key, col).select("id", step(F.col("text")).alias("text"))


# Dimensions


@query
def lexicon_terms(spark, sf_dir):
    terms = dimensions.lexicon_from_json(fixtures.benchmark_json(spark, sf_dir))
    return terms.select(F.col("cat_no.row_no").alias("file_no"), "cat_no.place", "code", "term")


@query
def lexicon_table(spark, sf_dir):
    raw = fixtures.part_lexicon(spark, sf_dir)
    return dimensions.numbered(
        dimensions.lexicon_from_table(raw, dimensions.MIN_TERM_LENGTH)
    )


@query
def lexicon_profile(spark, sf_dir):
    return report.lexicon_profile(
        dimensions.lexicon_from_table(fixtures.part_lexicon(spark, sf_dir))
    )


@query
def intent_dim(spark, sf_dir):
    return dimensions.intents_from_table(fixtures.customer_intents(spark, sf_dir))


@query
def valid_codes(spark, sf_dir):
    return dimensions.valid_codes(
        dimensions.labelled_intents(fixtures.customer_intents(spark, sf_dir))
    )


@query
def few_shots(spark, sf_dir):
    return dimensions.few_shots(
        dimensions.labelled_intents(fixtures.customer_intents(spark, sf_dir))
    )


@query
def intent_routing(spark, sf_dir):
    lexicon = dimensions.lexicon_from_table(
        fixtures.part_lexicon(spark, sf_dir), dimensions.MIN_TERM_LENGTH
    )
    intents = dimensions.intents_from_table(fixtures.customer_intents(spark, sf_dir))
    return dimensions.route_intents(intents, lexicon)


@query
def kb_profile(spark, sf_dir):
    lexicon = dimensions.lexicon_from_table(
        fixtures.part_lexicon(spark, sf_dir), dimensions.MIN_TERM_LENGTH
    )
    return report.kb_profile(
        lexicon, dimensions.intents_from_table(fixtures.customer_intents(spark, sf_dir))
    )


# Text


@query
def ascii_fold(spark, sf_dir):
    return _step(spark, sf_dir, "documents", "doc_id", "text", text.ascii_fold)


@query
def strip_html(spark, sf_dir):
    return _step(spark, sf_dir, "pages", "page_id", "html", text.strip_html)


@query
def strip_headers(spark, sf_dir):
    docs = fixtures.table(spark, sf_dir, "documents")
    mail = spread(docs.select("doc_id", "source", "text")).select(
        F.col("doc_id").alias("id"),
        F.concat(
            F.lit("From: "), "source", F.lit("\nSubject: x\n-- original message --\n"), "text",
            F.lit("\n____\nBcc: "), "source",
        ).alias("text"),
    )
    return mail.select("id", text.strip_headers(F.col("text")).alias("text"))


@query
def strip_urls(spark, sf_dir):
    return _step(spark, sf_dir, "pages", "page_id", "html", text.strip_urls)


@query
def strip_addresses(spark, sf_dir):
    return _step(spark, sf_dir, "documents", "doc_id", "text", text.strip_addresses)


@query
def clean_text(spark, sf_dir):
    pages = _texts(spark, sf_dir, "pages", "page_id", "html")
    docs = _texts(spark, sf_dir, "documents", "doc_id", "text")
    turns = spread(fixtures.table(spark, sf_dir, "conversations")).select(
        F.col("conv_id").alias("id"), F.col("turn").cast("bigint").alias("turn"), "text"
    )
    docs, pages = (df.withColumn("turn", F.lit(None).cast("bigint")) for df in (docs, pages))
    named = [
        df.select(F.lit(name).alias("table_name"), "id", "turn", "text")
        for name, df in [("documents", docs), ("pages", pages), ("conversations", turns)]
    ]
    every = named[0].unionByName(named[1]).unionByName(named[2])
    return every.withColumn("text", text.clean_text(F.col("text")))


@query
def weighted_text(spark, sf_dir):
    return matching.weighted_texts(fixtures.messages(spark, sf_dir))


# Keyphrases


@query
def keyphrase_counts(spark, sf_dir):
    return matching.keyphrase_counts(
        fixtures.messages(spark, sf_dir), _keyphrase_lexicon(spark)
    )


@query
def keyphrase_counts_wide(spark, sf_dir):
    """The same with a lexicon that grows with the data."""
    return matching.keyphrase_counts(
        fixtures.messages(spark, sf_dir), fixtures.benchmark_lexicon(spark, sf_dir)
    )


@query
def keyphrase_counts_shuffled(spark, sf_dir):
    """The wide lexicon as one that no executor holds."""
    return matching.keyphrase_counts_shuffled(
        fixtures.messages(spark, sf_dir), fixtures.benchmark_lexicon(spark, sf_dir)
    )


@query
def keyphrase_json(spark, sf_dir):
    return matching.keyphrase_json(
        fixtures.messages(spark, sf_dir), keyphrase_counts(spark, sf_dir)
    )


@query
def match_summary(spark, sf_dir):
    return report.match_summary(
        fixtures.messages(spark, sf_dir),
        keyphrase_counts(spark, sf_dir),
        _keyphrase_lexicon(spark),
    )


@query
def match_summary_json(spark, sf_dir):
    """Over a JSON lexicon, of which two categories have no terms."""
    messages = fixtures.messages(spark, sf_dir)
    lexicon = dimensions.lexicon_from_json(fixtures.lexicon_json(spark, sf_dir))
    summary = report.match_summary(messages, matching.keyphrase_counts(messages, lexicon), lexicon)
    return summary.select(F.col("cat_no.place").alias("place"), "code", "matched", "pct")


# Files


def _enriched(spark, sf_dir, suffix, out):
    """Mail of `documents` in a file, read by suffix, enriched, written, and read again."""
    staging = Staging(spark)
    mail = fixtures.messages(spark, sf_dir).select(
        F.col("guid").alias("Id"), F.col("subject").alias("[Subject]"), F.col("body").alias(" Body")
    )
    source, target = (f"{staging.path}/{name}" for name in (f"mail{suffix}", f"enriched{out}"))
    files.write_enriched(mail, source)
    lexicon = fixtures.lexicon_json(spark, sf_dir).select("value")
    lexicon.write.text(f"{staging.path}/terms")
    jobs.keyphrase_job(spark, source, f"{staging.path}/terms/*.txt", target, key="Id")
    return files.as_messages(files.read_table(spark, target), "Id", "keyphrase_stats")


@query
def enriched_parquet(spark, sf_dir):
    return _enriched(spark, sf_dir, ".parquet", ".parquet")


@query
def enriched_csv(spark, sf_dir):
    return _enriched(spark, sf_dir, ".csv", ".parquet")


@query
def enriched_tsv(spark, sf_dir):
    return _enriched(spark, sf_dir, ".tsv", ".csv")


# Rules


@query
def token_set(spark, sf_dir):
    return matching.token_set(fixtures.messages(spark, sf_dir))


@query
def single_word_hits(spark, sf_dir):
    hits = _hits(spark, sf_dir).where(~F.col("is_phrase"))
    return hits.select("guid", "code", "term", "score")


@query
def phrase_hits(spark, sf_dir):
    hits = _hits(spark, sf_dir).where("is_phrase")
    totals = hits.groupBy("guid", "code", "term").agg(
        F.sum("times").alias("times"), F.sum("score").alias("score")
    )
    return totals.where("times > 0")


@query
def keyword_hits(spark, sf_dir):
    return matching.keyword_hits(_hits(spark, sf_dir))


@query
def category_scores(spark, sf_dir):
    return matching.category_scores(_hits(spark, sf_dir))


@query
def category_scores_weighted(spark, sf_dir):
    return matching.category_scores(_hits(spark, sf_dir), "weighted")


@query
def ranked_categories(spark, sf_dir):
    return triage.ranked_categories(category_scores(spark, sf_dir))


@query
def candidate_intents(spark, sf_dir):
    return triage.candidate_intents(ranked_categories(spark, sf_dir), _rules(spark))


def _pruned(spark, sf_dir, mode):
    decisions = triage.triage(fixtures.messages(spark, sf_dir), _rules(spark), mode)
    return decisions.where(F.size("candidate_intents") > 0).select(
        "guid", "match_source", F.posexplode("final_intents").alias("place", "intent_code")
    )


@query
def prune_exact(spark, sf_dir):
    return _pruned(spark, sf_dir, "exact")


@query
def prune_domain(spark, sf_dir):
    return _pruned(spark, sf_dir, "domain")


@query
def prune_fuzzy(spark, sf_dir):
    return _pruned(spark, sf_dir, "fuzzy")


@query
def recipient_only(spark, sf_dir):
    return triage.recipient_only(fixtures.messages(spark, sf_dir), _rules(spark))


def _flat(decisions: DataFrame) -> DataFrame:
    return decisions.select(
        "guid",
        F.array_join("matched_categories", ",").alias("matched_categories"),
        F.array_join("candidate_intents", ",").alias("candidate_intents"),
        F.array_join("final_intents", ",").alias("final_intents"),
        "match_source",
        "confidence",
    )


def triage_decisions(spark, sf_dir):
    return _flat(triage.triage(fixtures.messages(spark, sf_dir), _rules(spark)))


query(triage_decisions, "triage")


@query
def triage_weighted_domain(spark, sf_dir):
    return _flat(
        triage.triage(fixtures.messages(spark, sf_dir), _rules(spark), "domain", "weighted")
    )


@query
def triage_audit(spark, sf_dir):
    """Decisions with the audit map as JSON."""
    messages, rules = fixtures.messages(spark, sf_dir), _rules(spark)
    decided = triage.with_keyword_hits(triage.triage(messages, rules), rules.hits(messages))
    return decided.select("guid", "match_source", F.to_json("keyword_hits").alias("keyword_hits"))


@query
def triage_with_fallback(spark, sf_dir):
    decided = jobs.with_predictor(
        fixtures.messages(spark, sf_dir), _rules(spark), fixtures.open_fallback_stub
    )
    return _flat(decided)


@query
def source_breakdown(spark, sf_dir):
    return report.source_breakdown(
        triage.triage(fixtures.messages(spark, sf_dir), _rules(spark))
    )


@query
def multi_intent(spark, sf_dir):
    return report.multi_intent(
        triage.triage(fixtures.messages(spark, sf_dir), _rules(spark), "domain")
    )


# Queue, prompts, predictions


@query
def work_queue(spark, sf_dir):
    waiting = queue.work_queue(fixtures.messages(spark, sf_dir), QUEUE_LENGTH)
    return waiting.select("guid", "subject", "body", "to", "from")


@query
def backlog(spark, sf_dir):
    waiting = queue.work_queue(fixtures.messages(spark, sf_dir))
    return waiting.select("guid", "subject", "body", "to", "from")


@query
def apply_predictions(spark, sf_dir):
    labels = fixtures.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("guid"), "quality", "toxic"
    )
    first = labels.select("guid", F.lit("Account").alias("predicted"), F.lit(1).alias("seq"))
    second = labels.where("quality = 1").select(
        "guid", F.concat(F.lit("Toxic_"), "toxic").alias("predicted"), F.lit(2).alias("seq")
    )
    after = queue.apply_predictions(
        fixtures.messages(spark, sf_dir), first.unionByName(second), PREDICTED_AT
    )
    return after.select(
        "guid", "subject", "body", "predicted",
        F.col("predicted_date").cast("string").alias("predicted_date"),
    )


@query
def upsert_buckets(spark, sf_dir):
    """A batch merged, one logged and merged, and one logged only, over a table in buckets."""
    labels = fixtures.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("guid"), "quality", "toxic", F.lit(1).alias("seq")
    )
    mail = BucketedTable.create(
        fixtures.messages(spark, sf_dir), f"{Staging(spark).path}/mail", buckets=32
    )
    mail.upsert(labels.withColumn("predicted", F.lit("Account")), PREDICTED_AT)
    mail.log(labels.where("quality = 1").withColumn("predicted", F.lit("Legal")), "2024-06-02 12:00:00")
    mail.compact()
    mail.log(labels.where("toxic = 1").withColumn("predicted", F.lit(None).cast("string")), "2024-06-03 12:00:00")
    return mail.read().select("guid", "subject", "predicted", F.col("predicted_date").cast("string").alias("predicted_date"))


@query
def user_prompt(spark, sf_dir):
    messages = fixtures.messages(spark, sf_dir)
    return messages.select("guid", prompts.user_prompt().alias("prompt"))


@query
def prompt_terms(spark, sf_dir):
    return prompts.prompt_terms(
        dimensions.lexicon_from_table(fixtures.part_lexicon(spark, sf_dir))
    )


@query
def context_block(spark, sf_dir):
    return prompts.context_block(
        dimensions.lexicon_from_table(fixtures.part_lexicon(spark, sf_dir)),
        dimensions.labelled_intents(fixtures.customer_intents(spark, sf_dir)),
        ORGANISATION,
    )


def _asked(spark, sf_dir):
    context = prompts.context_block(
        _keyphrase_lexicon(spark), _labelled(spark), ORGANISATION
    )
    return prompts.full_prompts(queue.work_queue(fixtures.messages(spark, sf_dir)), context)


@query
def full_prompts(spark, sf_dir):
    return _asked(spark, sf_dir)


@query
def predict_stub(spark, sf_dir):
    return predict.predict(_asked(spark, sf_dir), fixtures.open_stub)


@query
def predict_by_sender(spark, sf_dir):
    """Each sender's own predictor asked about all their messages, from SQL."""
    asked = fixtures.messages(spark, sf_dir).select(
        F.col("from").alias("organisation"), "guid", prompts.user_prompt().alias("prompt")
    )
    table_functions.register_predictor(spark, "ask_predictor", fixtures.open_stub_of)
    return spark.sql(
        "SELECT * FROM ask_predictor(TABLE({asked}) PARTITION BY (organisation, part))",
        asked=table_functions.parted(asked, rows=20),
    )


@query
def parse_responses(spark, sf_dir):
    parsed = predict.parse_responses(
        fixtures.responses(spark, sf_dir), dimensions.valid_codes(_labelled(spark))
    )
    return parsed.select("guid", "predicted_intent", "predicted_code")


@query
def parse_fallback(spark, sf_dir):
    parsed = predict.parse_fallback(
        fixtures.fallback_responses(spark, sf_dir), _labelled(spark).select("intent_code")
    )
    return parsed.select("guid", F.array_join("final_intents", ",").alias("final_intents"))


@query
def intent_distribution(spark, sf_dir):
    answered = predict.predictions(predict_stub(spark, sf_dir))
    parsed = predict.parse_responses(answered, dimensions.valid_codes(_labelled(spark)))
    return report.intent_distribution(parsed)


@query
def failed_predictions(spark, sf_dir):
    return predict.errors(predict_stub(spark, sf_dir))


@query
def run_totals(spark, sf_dir):
    return report.run_totals(predict_stub(spark, sf_dir))


# Over time


@query
def prediction_as_of(spark, sf_dir):
    """The last order a customer had made at each event of theirs, as a prediction that stood."""
    moments = fixtures.table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("guid"), F.col("ts").alias("at")
    )
    made = fixtures.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 100).alias("guid"), fixtures.order_time().alias("at"),
        "o_orderpriority", "o_orderkey",
    )
    stood = history.as_of(moments, made, "guid", "at", ["o_orderkey", "o_orderpriority"])
    return stood.select("event_id", "guid", "o_orderkey", "o_orderpriority")


@query
def intents_in_force(spark, sf_dir):
    """Which customers' intents were valid for the nation of a message's source when it came."""
    mail = fixtures.messages(spark, sf_dir).select("guid", "date", fixtures.source_number().alias("nation"))
    valid = fixtures.table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("int").alias("nation"), *fixtures.validity()
    )
    met = history.in_force(mail, valid, ["nation"], "date", "valid_from", "valid_to")
    return met.select("guid", "c_custkey", "nation")


@query
def sender_threads(spark, sf_dir):
    found = history.threads(
        fixtures.messages(spark, sf_dir), "from", "date", "guid", gap=1_300, chunk=14_400
    )
    return found.withColumnRenamed("key", "guid")


@query
def recipient_load(spark, sf_dir):
    found = history.moving_counts(
        fixtures.messages(spark, sf_dir), "to", "date", "guid", seconds=1_800, chunks=4
    )
    return found.select(F.col("key").alias("guid"), F.col("who").alias("recipient"), "n")


@query
def arrivals_by_hour(spark, sf_dir):
    """Hours that are complete, of mail that arrived as files."""
    staging = Staging(spark)
    mail = fixtures.messages(spark, sf_dir).select("guid", "date", "predicted")
    mail.unionByName(mail.where("predicted = 'Legal'")).write.parquet(f"{staging.path}/inbox")
    stream = spark.readStream.schema(mail.schema).parquet(f"{staging.path}/inbox")
    counts = arrivals.windowed_counts(stream, "date", "predicted")
    arrivals.store_windows(counts, f"{staging.path}/hours", f"{staging.path}/state").awaitTermination()
    found = spark.read.schema(counts.schema).parquet(f"{staging.path}/hours")
    return found.select(F.col("start").cast("string").alias("start"), "predicted", "n")


# Several levels, sketches, runs


@query
def label_rollup(spark, sf_dir):
    mail = fixtures.messages(spark, sf_dir).select(F.col("from").alias("sender"), "predicted", F.col("to").alias("recipient"))
    return summaries.rolled_up(mail, ["predicted", "recipient", "sender"])


@query
def sender_sketches(spark, sf_dir):
    """Distinct words a category was written in, from sketches per sender, against the exact number."""
    words = matching.token_set(fixtures.messages(spark, sf_dir)).join(
        fixtures.messages(spark, sf_dir).select("guid", "predicted", F.col("from").alias("sender")), "guid"
    )
    stored = Staging(spark).written(summaries.sketches(words, ["predicted", "sender"], "token"), "sketches")
    exact = words.groupBy("predicted").agg(F.count_distinct("token").alias("exact"))
    estimated = summaries.merged(stored, ["predicted"])
    near = F.abs(F.col("distinct") - F.col("exact")) <= 0.05 * F.col("exact") + 1
    same = estimated["predicted"].eqNullSafe(exact["predicted"])
    return estimated.join(exact, same).select(estimated["predicted"], "n", "exact", near.alias("near"))


@query
def compared_runs(spark, sf_dir):
    """What two batches of predictions changed, by the new label."""
    mail = fixtures.messages(spark, sf_dir)
    labels = fixtures.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("guid"), F.lit("Legal").alias("predicted"), F.col("quality").alias("seq")
    )
    after = queue.apply_predictions(mail, labels, PREDICTED_AT)
    return summaries.changes_by(mail, after, ["to", "from", "predicted"], "predicted")
