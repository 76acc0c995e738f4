"""What the registered queries read: views of the given tables as mail and dimensions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.functions.text import clean_text
from postroom.operators.predict import one_by_one
from postroom.operators.sizing import spread

# The small lexicon and intent table used with `documents`.
LEXICON = [
    ("Billing", "of the"),
    ("Billing", "orre"),
    ("Billing", "orre"),
    ("Billing", "er"),
    ("Billing_BS", "thanedble"),
    ("Billing_BS", "and attion"),
    ("Account", "de la"),
    ("Account", "und"),
    ("Account", "the the"),
    ("Legal", "license"),
    ("Legal", "all rights"),
    ("Legal", "mit license"),
    ("Misc", "und"),
    ("Misc", "e-bill"),
    ("Misc", " DES "),
    ("Misc", None),
]
INTENTS = [
    ("Billing", "Billing", "billing@util.example.com"),
    ("Billing_BS", "Business billing", "Business@util.example.com"),
    ("Billing_BS", "Business billing", "help@util.example.com"),
    ("Acc", "Account", "account@util.example.com"),
    ("Account_Move", "Moving", "move@other.example.org"),
    ("Outage", "Outage", "outage@util.example.com"),
    ("Legal", "Legal", "legal@util.example.com"),
]
RECIPIENTS = [
    "billing@util.example.com",
    " Business@Util.Example.com ",
    "help@util.example.com",
    "outage@util.example.com",
    "nobody@util.example.com",
    None,
    "move@other.example.org",
]


def _literal(value) -> str:
    if value is None:
        return "CAST(NULL AS VARCHAR(200))"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def values_sql(rows, *names: str) -> str:
    """Rows as a SELECT that Spark and other engines read alike, numbered from one."""
    body = ", ".join(
        "(" + ", ".join(_literal(v) for v in (i, *row)) + ")" for i, row in enumerate(rows, 1)
    )
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(('row_no', *names))})"


def lexicon_table(spark: SparkSession) -> DataFrame:
    return spark.sql(values_sql(LEXICON, "Category_Code", "Term")).select(
        "row_no", F.lit(None).cast("string").alias("Category"), "Category_Code", "Term"
    )


def intent_table(spark: SparkSession) -> DataFrame:
    return spark.sql(values_sql(INTENTS, "Intent_Code", "Intent", "Email"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as mail: the first line is the subject, the rest the body."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    docs = spread(docs.withColumn("guid", F.col("doc_id").cast("string")))
    first_break = F.instr("text", "\n")
    recipient = F.get(
        F.array(*[F.lit(r) for r in RECIPIENTS]), (F.col("doc_id") % 7).cast("int")
    )
    predicted = F.get(
        F.array(F.lit(None), F.lit("Unclassified"), F.lit("Billing"), F.lit("Legal")),
        (F.col("doc_id") % 4).cast("int"),
    )
    return docs.select(
        "guid",
        F.when(
            F.col("doc_id") % 97 != 0,
            F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60),
        ).alias("date"),
        F.concat("source", F.lit("@mail.example.com")).alias("from"),
        recipient.alias("to"),
        F.when(first_break > 0, F.substring("text", F.lit(1), first_break - 1))
        .otherwise(F.col("text"))
        .alias("subject"),
        F.when(first_break > 0, F.substring("text", first_break + 1, F.length("text")))
        .otherwise("")
        .alias("body"),
        predicted.alias("predicted"),
        F.lit(None).cast("timestamp").alias("predicted_date"),
        F.lit(None).cast("string").alias("confirmed"),
        F.lit(None).cast("string").alias("confirmed_by"),
    )


# Expressions that Spark and the oracle read alike: `part` as a lexicon table,
# `customer` as an intent table, with gaps, repeats, stray blanks and case.
PART_LEXICON = [
    "p_partkey + 1 AS row_no",
    "p_type AS Category",
    "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE concat(' ', p_brand, ' ') END AS Category_Code",
    "CASE WHEN p_partkey % 17 = 0 THEN NULL"
    " WHEN p_partkey % 19 = 0 THEN concat(' ', substr(p_name, 1, 2))"
    " WHEN p_partkey % 3 = 0 THEN substr(p_name, 1, 4)"
    " WHEN p_partkey % 5 = 0 THEN concat(upper(p_name), ' ') ELSE p_name END AS Term",
]
CUSTOMER_INTENTS = [
    "c_custkey + 1 AS row_no",
    "CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN 'Brand'"
    " WHEN c_custkey % 10 = 0 THEN 'Unclassified' WHEN c_custkey % 12 = 0 THEN c_mktsegment"
    " WHEN c_custkey % 3 = 0 THEN concat('Brand#', c_custkey % 30, ' ')"
    " ELSE concat('Brand#', c_custkey % 30, '_', substr(c_mktsegment, 1, 2), '_', c_custkey % 2)"
    " END AS Intent_Code",
    "CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE concat(' ', c_mktsegment) END AS Intent",
    "CASE WHEN c_custkey % 29 = 0 THEN NULL"
    " ELSE concat(c_name, '@N', c_nationkey, '.Example.com ') END AS Email",
]


def part_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*PART_LEXICON)


def customer_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*CUSTOMER_INTENTS)


def benchmark_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_no, value): each item of `benchmark` as a JSON lexicon of three categories."""
    words = F.split("text", " ")
    code = F.concat(F.lit('"item_'), F.col("item_id").cast("string"))
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("row_no"),
        F.concat(
            F.lit("{"), code, F.lit('": {"terms": '), F.to_json(words), F.lit("}, "),
            code, F.lit('_head": {"terms": '), F.to_json(F.slice(words, 1, 5)), F.lit("}, "),
            code, F.lit('_none": {}}'),
        ).alias("value"),
    )


def benchmark_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_no, code, term): the words and adjacent word pairs of each `benchmark` item."""
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("row_no"),
        F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("code"),
        F.split(clean_text(F.col("text")), " ").alias("words"),
    )
    at = items.select("row_no", "code", "words", F.posexplode("words").alias("pos", "word"))
    pair = F.concat("word", F.lit(" "), F.get("words", F.col("pos") + 1))
    return at.select("row_no", "code", F.explode(F.array(F.col("word"), pair)).alias("term")).where(
        F.col("term").isNotNull()
    )


def lexicon_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_no, value): the small lexicon as one JSON text, with a category that has no terms
    and one that names none."""
    terms: dict[str, list[str]] = {}
    for code, term in LEXICON:
        terms.setdefault(code, []).extend([] if term is None else [term])
    value = json.dumps({**{c: {"terms": t} for c, t in terms.items()}, "Empty": {"terms": []}, "Bare": {}})
    return spark.range(1).select(F.lit(0).cast("bigint").alias("row_no"), F.lit(value).alias("value"))


# Where orders and customers stand for a history: seconds and minutes into the month of the events.
def order_time() -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + F.col("o_orderkey") * 7919 % 2_592_000)


def source_number() -> Column:
    """The number in a message's sender address."""
    return F.regexp_extract("from", "([0-9]+)", 1).cast("int")


def validity() -> list[Column]:
    """Most intents are valid for up to an hour and a half, one in seventeen for up to twelve days."""
    start = F.lit(1704067200) + F.col("c_custkey") * 3571 % 1_440 * 60
    minutes = F.when(F.col("c_custkey") % 17 == 0, F.col("c_custkey") % 290 * 60).otherwise(F.col("c_custkey") % 90)
    return [F.timestamp_seconds(start).alias("valid_from"), F.timestamp_seconds(start + minutes * 60).alias("valid_to")]


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(guid, raw): answers of every good and bad shape, wrapped around `documents`."""
    return table(spark, sf_dir, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS guid", f"{RESPONSE} AS raw"
    )


def fallback_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS guid", f"{FALLBACK_RESPONSE} AS raw"
    )


# Answers as one expression that Spark and the oracle read alike.
RESPONSE = """CASE doc_id % 13
 WHEN 0 THEN concat('ok {"intent": "', lang, '", "intent_code": "Billing"} bye ', text)
 WHEN 1 THEN concat('{"intent": " ', source, ' ", "intent_code": "bILLING "}')
 WHEN 2 THEN '{"intent": "x", "intent_code": "Nope"}'
 WHEN 3 THEN concat('{"intent": "', source, '", "intent_code": "LEGAL", "n": ', n_chars, '} {}')
 WHEN 4 THEN '{"intent": null, "intent_code": " Legal "}'
 WHEN 5 THEN '{"intent_code": "Legal"}'
 WHEN 6 THEN concat('no json ', text)
 WHEN 7 THEN concat('{"intent": ', n_chars, ', "intent_code": "Outage"}')
 WHEN 8 THEN '{"intent": true, "intent_code": "account_move"}'
 WHEN 9 THEN '{"intent": "x", "intent_code": "Billing",}'
 WHEN 10 THEN '{"intent": "x", "intent_code": null}'
 WHEN 11 THEN concat('{} { ', lang, ' } {"intent": "x", "intent_code": "Billing"}')
 ELSE concat('{"a": {"intent": "', lang, '", "intent_code": "Acc"}}') END"""
FALLBACK_RESPONSE = """CASE doc_id % 7
 WHEN 0 THEN '{"intent_codes": ["Billing", "Nope", "Legal", "Billing"]}'
 WHEN 1 THEN concat('sure: {"intent_codes": ["Outage"], "why": "', lang, '"} ', text)
 WHEN 2 THEN '{"intent_codes": []}'
 WHEN 3 THEN concat('none ', source)
 WHEN 4 THEN '{"intent_codes": "Billing"}'
 WHEN 5 THEN '{"codes": ["Billing"]}'
 ELSE concat('{"intent_codes": ["', lang, '", "Account_Move"]}') END"""


def open_stub():
    """A deterministic predictor: the answer depends on the prompt's length."""

    @one_by_one
    def answer(prompt: str) -> str:
        n = len(prompt)
        if n % 11 == 0:
            raise ValueError(f"no answer for {n} characters")
        code = ["Billing", "legal", "Account_Move", "Nope"][n % 4]
        return f'{{"intent": "label {n % 5}", "intent_code": "{code}"}}'

    return answer


def open_fallback_stub():
    @one_by_one
    def answer(prompt: str) -> str:
        n = len(prompt)
        if n % 5 == 0:
            raise ValueError("no answer")
        return '{"intent_codes": ["%s", "Nope", "Legal"]}' % ["Outage", "Acc", "none"][n % 3]

    return answer


def open_stub_of(organisation: str | None):
    """A predictor of one organisation; one sender has none."""
    if organisation.startswith("src7@"):
        raise LookupError(f"no predictor of {organisation}")

    @one_by_one
    def answer(prompt: str) -> str:
        if len(prompt) % 13 == 0:
            raise ValueError("no answer")
        return f"{organisation} {len(prompt) % 7}"

    return answer
