"""From category scores to a decision per message.

Everything after scoring is narrow: one row per message and category, gathered
once per message. The gathered lists hold at most one entry per category and
per intent code, so no message outgrows a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postroom.functions.text import strip_blanks, text_or_empty
from postroom.operators.dimensions import (
    MIN_TERM_LENGTH,
    UNCLASSIFIED,
    first_per_code,
    intents_from_table,
    lexicon_from_table,
    numbered,
    route_intents,
)
from postroom.operators.matching import category_scores, keyword_hits, rule_hits
from postroom.operators.sizing import broadcast_passes, is_small, lookup

# Sources and confidences of a decision.
KEYWORD_EMAIL, KEYWORD_ONLY, KEYWORD_NO_INTENT = "keyword+email_", "keyword_only", "keyword_no_intent"
EMAIL_ONLY, FALLBACK, UNMATCHED = "email_only", "llm_fallback", "unmatched"
HIGH, MEDIUM, LOW = "high", "medium", "low"
# Stands for a missing guid on the way through the joins.
NO_GUID = "\0"
ADDRESS_MODES = ("exact", "domain", "fuzzy")


@dataclass(frozen=True)
class Rules:
    """The dimensions of the rule matcher, with their size measured once.

    Every table derived from them has at most as many rows as its source (the
    prefix keys of routing aside, and those are joined, never gathered).
    """

    lexicon: DataFrame
    intents: DataFrame
    passes: int
    small: bool  # whether the intents fit one broadcast

    @classmethod
    def load(cls, lexicon_table: DataFrame, intent_table: DataFrame) -> Rules:
        lexicon = lexicon_from_table(lexicon_table, MIN_TERM_LENGTH)
        intents = intents_from_table(intent_table)
        passes, small = broadcast_passes(lexicon), is_small(intents)
        # One task holds a table that fits one broadcast, so tables derived from it
        # need no shuffle.
        if passes == 1:
            lexicon = lexicon.coalesce(1)
        if small:
            intents = intents.coalesce(1)
        return cls(lexicon, intents, passes, small)

    def hits(self, messages: DataFrame, bucketed: bool = False) -> DataFrame:
        return rule_hits(messages, numbered(self.lexicon), self.passes, bucketed)

    def candidates(self) -> DataFrame:
        """Only the first row of each intent code can become a candidate."""
        return route_intents(first_per_code(self.intents), self.lexicon)


def ranked_categories(scores: DataFrame) -> DataFrame:
    """(guid, rank, code, score): best score first, ties in file order."""
    order = W.partitionBy("guid").orderBy(F.desc("score"), "cat_no")
    return scores.select(
        "guid", F.row_number().over(order).cast("bigint").alias("rank"), "code", "score"
    )


def candidate_intents(ranked: DataFrame, rules: Rules) -> DataFrame:
    """(guid, rank, category, row_no, intent_code, email) in the order rank, row_no."""
    by_category = lookup(rules.candidates(), rules.small)
    return ranked.join(by_category, ranked["code"] == by_category["category"]).select(
        "guid", "rank", "category", "row_no", "intent_code", "email"
    )


def has_recipient(to: Column) -> Column:
    return text_or_empty(to) != ""


def clean_address(to: Column) -> Column:
    return F.lower(strip_blanks(text_or_empty(to)))


def survives(email: Column, address: Column, mode: str) -> Column:
    """Does an intent's address agree with a cleaned recipient?"""
    if mode == "exact":
        return email == address
    if mode == "domain":
        at_end = F.when(
            F.contains(address, F.lit("@")), F.substring_index(address, "@", -1)
        ).otherwise("")
        return F.substring_index(email, "@", -1) == at_end
    if mode == "fuzzy":
        return F.contains(email, address) | F.contains(address, email)
    raise ValueError(f"mode must be one of {ADDRESS_MODES}, not {mode!r}")


def by_address(intents: DataFrame) -> DataFrame:
    """(email, codes): the distinct intent codes of an address in file order."""
    first = intents.groupBy("email", "intent_code").agg(F.min("row_no").alias("row_no"))
    listed = F.array_sort(F.collect_list(F.struct("row_no", "intent_code")))
    return first.groupBy("email").agg(
        F.transform(listed, lambda i: i["intent_code"]).alias("codes")
    )


def _gathered(scores: DataFrame, rules: Rules) -> DataFrame:
    """(guid, matched_categories, candidates), both in rank order."""
    listed = F.array_sort(F.collect_list(F.struct("row_no", "intent_code", "email")))
    per_category = rules.candidates().groupBy("category").agg(listed.alias("intents"))
    dim = lookup(per_category, rules.small)
    ranked = F.array_sort(
        F.collect_list(F.struct((-F.col("score")).alias("best"), "cat_no", "code", "intents"))
    )
    return (
        scores.join(dim, scores["code"] == dim["category"], "left")
        .groupBy("guid")
        .agg(ranked.alias("ranked"))
        .select(
            "guid",
            F.transform("ranked", lambda c: c["code"]).alias("matched_categories"),
            F.flatten(
                F.transform(
                    F.filter("ranked", lambda c: c["intents"].isNotNull()),
                    lambda c: c["intents"],
                )
            ).alias("candidates"),
        )
    )


def triage(
    messages: DataFrame,
    rules: Rules,
    address_mode: str = "exact",
    score_mode: str = "count",
    carry: Column | None = None,
    bucketed: bool = False,
) -> DataFrame:
    """One decision per message of ``messages(guid, to, subject, body)``.

    (guid, matched_categories, candidate_intents, final_intents, match_source,
    confidence). ``carry`` adds one column over the messages, for callers that
    go on with the undecided. A message without a guid is decided like any other if
    it is the only one; the jobs refuse guids that repeat. ``bucketed`` says that the
    messages come from a table bucketed by guid.
    """
    if not bucketed:
        # A null would not find its hits again; a stand-in keeps the join a plain one.
        messages = messages.withColumn("guid", F.coalesce("guid", F.lit(NO_GUID)))
    scores = category_scores(rules.hits(messages, bucketed), score_mode)
    kept = [] if carry is None else [carry.alias("carried")]
    every = messages.select("guid", "to", *kept)
    recipients = lookup(by_address(rules.intents), rules.small)
    joined = every.join(_gathered(scores, rules), "guid", "left").withColumn(
        "address", F.when(has_recipient(F.col("to")), clean_address(F.col("to")))
    )
    joined = joined.join(recipients, joined["address"] == recipients["email"], "left")

    candidates = F.coalesce("candidates", F.array())
    address = F.col("address")
    agreeing = F.when(
        address.isNotNull(),
        F.filter("candidates", lambda c: survives(c["email"], address, address_mode)),
    )
    decided = joined.withColumn("agreeing", agreeing).withColumn(
        "match_source",
        F.when(
            F.col("matched_categories").isNotNull(),
            F.when(F.size(candidates) == 0, KEYWORD_NO_INTENT)
            .when(F.coalesce(F.size("agreeing") > 0, F.lit(False)), KEYWORD_EMAIL + address_mode)
            .otherwise(KEYWORD_ONLY),
        )
        .when(F.col("codes").isNotNull(), EMAIL_ONLY)
        .otherwise(UNMATCHED),
    )
    source = F.col("match_source")
    codes = lambda c: F.transform(c, lambda i: i["intent_code"])
    none = F.array().cast("array<string>")
    final = (
        F.when(source == KEYWORD_EMAIL + address_mode, codes("agreeing"))
        .when(source == KEYWORD_ONLY, codes("candidates"))
        .when(source == EMAIL_ONLY, F.col("codes"))
        .otherwise(F.array(F.lit(UNCLASSIFIED)))
    )
    confidence = (
        F.when(source.isin(KEYWORD_ONLY, EMAIL_ONLY), MEDIUM)
        .when(source == UNMATCHED, LOW)
        .otherwise(HIGH)
    )
    return decided.select(
        "guid" if bucketed else F.when(F.col("guid") != NO_GUID, F.col("guid")).alias("guid"),
        F.coalesce("matched_categories", none).alias("matched_categories"),
        F.coalesce(codes("candidates"), none).alias("candidate_intents"),
        final.alias("final_intents"),
        "match_source",
        confidence.alias("confidence"),
        *(["carried"] if kept else []),
    )


def recipient_only(messages: DataFrame, rules: Rules, score_mode: str = "count") -> DataFrame:
    """(guid, place, intent_code) of messages without a keyword whose recipient is known."""
    return (
        triage(messages, rules, score_mode=score_mode)
        .where(F.col("match_source") == EMAIL_ONLY)
        .select("guid", F.posexplode("final_intents").alias("place", "intent_code"))
    )


def with_keyword_hits(decisions: DataFrame, hits: DataFrame) -> DataFrame:
    """Add the audit map ``{category: [terms, repeats included]}``."""
    per_category = (
        keyword_hits(hits)
        .groupBy("guid", "code")
        .agg(F.array_sort(F.collect_list(F.struct("term", "n"))).alias("terms"))
    )
    listed = F.flatten(
        F.transform("terms", lambda t: F.array_repeat(t["term"], t["n"].cast("int")))
    )
    per_message = (
        per_category.select("guid", F.struct("code", listed.alias("found")).alias("entry"))
        .groupBy("guid")
        .agg(F.map_from_entries(F.array_sort(F.collect_list("entry"))).alias("keyword_hits"))
    )
    empty = F.from_json(F.lit("{}"), "map<string, array<string>>")
    return decisions.join(per_message, "guid", "left").withColumn(
        "keyword_hits", F.coalesce("keyword_hits", empty)
    )


def stored(decisions: DataFrame) -> DataFrame:
    """(guid, predicted, match_source, confidence): final intents as they are written back."""
    return decisions.select(
        "guid", F.array_join("final_intents", ",").alias("predicted"), "match_source", "confidence"
    )
