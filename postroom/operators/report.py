"""Coverage, breakdowns and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postroom.operators.dimensions import categories


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.lit(100.0) * part / whole).otherwise(F.lit(0.0))


def match_summary(messages: DataFrame, counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(cat_no, code, matched, pct): messages with a hit, for every category."""
    matched = counts.groupBy("code").agg(F.count_distinct("guid").alias("matched"))
    total = messages.select(F.count(F.lit(1)).alias("total")).scalar()
    n = F.coalesce("matched", F.lit(0).cast("bigint"))
    return (
        categories(lexicon)
        .join(matched, "code", "left")
        .select("cat_no", "code", n.alias("matched"), _percent(n, total).alias("pct"))
    )


def source_breakdown(decisions: DataFrame) -> DataFrame:
    """(match_source, n, pct), most frequent first. The window spans a handful of sources."""
    counts = decisions.groupBy("match_source").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy())
    return counts.select("match_source", "n", _percent(F.col("n"), total).alias("pct")).orderBy(
        F.desc("n"), "match_source"
    )


def multi_intent(decisions: DataFrame) -> DataFrame:
    return decisions.agg(
        F.count_if(F.size("final_intents") > 1).alias("multi"), F.count(F.lit(1)).alias("total")
    )


def intent_distribution(predictions: DataFrame) -> DataFrame:
    """(predicted_code, n), most frequent first."""
    return (
        predictions.groupBy("predicted_code")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "predicted_code")
    )


def run_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count_if(F.col("error").isNull()).alias("predicted"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def lexicon_profile(lexicon: DataFrame) -> DataFrame:
    """(code, terms) per category; repeats count."""
    return lexicon.groupBy("code").agg(F.count(F.lit(1)).alias("terms"))


def kb_profile(lexicon: DataFrame, intents: DataFrame) -> DataFrame:
    """One row: sizes of the lexicon and the intents as the rules hold them."""
    phrase = F.contains(F.col("term"), F.lit(" "))
    domain = F.substring_index("email", "@", -1)
    terms = lexicon.agg(
        F.count_distinct("code").alias("categories"),
        F.count(F.lit(1)).alias("terms"),
        F.count_distinct(F.when(~phrase, F.col("term"))).alias("single_word_terms"),
        F.count_distinct(F.when(phrase, F.col("term"))).alias("phrases"),
    )
    records = intents.agg(
        F.struct(
            F.count(F.lit(1)).alias("records"),
            F.count_distinct("intent_code").alias("intent_codes"),
            F.count_distinct("email").alias("addresses"),
            F.count_distinct(domain).alias("domains"),
        ).alias("of_intents")
    )
    # One scalar, so that the intents are read once.
    return terms.withColumn("of_intents", records.scalar()).select(*terms.columns, "of_intents.*")
