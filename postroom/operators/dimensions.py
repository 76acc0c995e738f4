"""The two dimensions: a lexicon of terms per category, and the intents.

Rows keep ``row_no``, their place in the file; every first-match rule orders by
it. Loaders are plain projections; ``numbered`` folds repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postroom.functions.text import strip_blanks

# Column names of the inputs, and the limits of the rules.
LEXICON_CODE, LEXICON_FALLBACK_CODE, LEXICON_TERM = "Category_Code", "Category", "Term"
INTENT_CODE, INTENT_LABEL, INTENT_EMAIL, INTENT_METHOD = "Intent_Code", "Intent", "Email", "Method"
UNCLASSIFIED = "Unclassified"
MIN_TERM_LENGTH = 3
FEW_SHOTS = 8


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _stripped(name: str) -> Column:
    return strip_blanks(_column(name).cast("string"))


def _by_plain_name(raw: DataFrame) -> dict[str, str]:
    return {name.strip(): name for name in raw.columns}


def lexicon_from_table(raw: DataFrame, min_length: int = 0) -> DataFrame:
    """(row_no, code, term) of a lexicon table; repeated rows stay.

    The rules want ``min_length=MIN_TERM_LENGTH``; prompts take every term.
    """
    names = _by_plain_name(raw)
    in_file = [n for n in raw.columns if n.strip() != "row_no"]
    code = names.get(LEXICON_CODE) or names[LEXICON_FALLBACK_CODE]
    term = names.get(LEXICON_TERM) or in_file[2]
    return (
        raw.where(_column(code).isNotNull() & _column(term).isNotNull())
        .select(
            F.col("row_no").cast("bigint").alias("row_no"),
            _stripped(code).alias("code"),
            F.lower(_stripped(term)).alias("term"),
        )
        .where(F.char_length("term") >= min_length)
    )


def lexicon_from_json(texts: DataFrame) -> DataFrame:
    """(cat_no, code, term) of JSON texts ``{code: {"terms": [...]}}`` in ``row_no, value``.

    Terms are distinct per code. ``cat_no`` is the pair of the text's number and the
    code's place in it. Each category also has one row with a null term, so that one
    without terms is still a category.
    """
    shape = "map<string, struct<terms: array<string>>>"
    entries = F.map_entries(F.from_json("value", shape))
    return (
        texts.select("row_no", F.posexplode(entries).alias("place", "entry"))
        .select(
            F.struct(F.col("row_no").cast("bigint").alias("row_no"), "place").alias("cat_no"),
            F.col("entry.key").alias("code"),
            F.explode(
                F.concat(
                    F.array(F.lit(None).cast("string")),
                    F.coalesce("entry.value.terms", F.array().cast("array<string>")),
                )
            ).alias("term"),
        )
        .withColumn("term", F.nullif(F.lower(strip_blanks(F.col("term"))), F.lit("")))
        .groupBy("code", "term")
        .agg(F.min("cat_no").alias("cat_no"))
        .select("cat_no", "code", "term")
    )


def numbered(lexicon: DataFrame) -> DataFrame:
    """One row per (code, term) with its multiplicity and the category's place.

    ``cat_no`` is the first surviving row of the category, so only its order counts.
    """
    terms = lexicon.groupBy("code", "term").agg(
        F.min("row_no").alias("row_no"), F.count(F.lit(1)).alias("mult")
    )
    return terms.join(categories(lexicon), "code").select(
        "cat_no", "code", "term", "row_no", "mult"
    )


def categories(lexicon: DataFrame) -> DataFrame:
    place = "cat_no" if "cat_no" in lexicon.columns else "row_no"
    return lexicon.groupBy("code").agg(F.min(place).alias("cat_no"))


def intents_from_table(raw: DataFrame) -> DataFrame:
    """(row_no, intent_code, intent, email, method) for the rules.

    Rows without code or address are dropped; addresses are compared in lower case.
    """
    names = _by_plain_name(raw)
    method = _column(names[INTENT_METHOD]).cast("string") if INTENT_METHOD in names else F.lit("")
    code, email = _column(names[INTENT_CODE]), _column(names[INTENT_EMAIL])
    return raw.where(code.isNotNull() & email.isNotNull()).select(
        F.col("row_no").cast("bigint").alias("row_no"),
        _stripped(names[INTENT_CODE]).alias("intent_code"),
        _stripped(names[INTENT_LABEL]).alias("intent"),
        F.lower(_stripped(names[INTENT_EMAIL])).alias("email"),
        F.coalesce(method, F.lit("")).alias("method"),
    )


def labelled_intents(raw: DataFrame) -> DataFrame:
    """(row_no, intent_code, intent, email) for prompts: addresses as written.

    Rows without code or label are dropped; a missing column is an error.
    """
    names = _by_plain_name(raw)
    for needed in (INTENT_EMAIL, INTENT_LABEL, INTENT_CODE):
        if needed not in names:
            raise ValueError(f"Column {needed!r} not found; available: {raw.columns}")
    code, label = _column(names[INTENT_CODE]), _column(names[INTENT_LABEL])
    return raw.where(code.isNotNull() & label.isNotNull()).select(
        F.col("row_no").cast("bigint").alias("row_no"),
        _stripped(names[INTENT_CODE]).alias("intent_code"),
        _stripped(names[INTENT_LABEL]).alias("intent"),
        _column(names[INTENT_EMAIL]).cast("string").alias("email"),
    )


def valid_codes(intents: DataFrame) -> DataFrame:
    return intents.select("intent_code").distinct().orderBy("intent_code")


def few_shots(intents: DataFrame, n: int = FEW_SHOTS) -> DataFrame:
    """The first row of each code in file order, and of those the first ``n``."""
    return (
        intents.where(F.col("intent_code") != UNCLASSIFIED)
        .groupBy("intent_code")
        .agg(F.min(F.struct("row_no", "intent", "email")).alias("first"))
        .select("first.row_no", "intent_code", "first.intent", "first.email")
        .orderBy("row_no")
        .limit(n)
    )


def route_intents(intents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Give each intent row its category: the first in file order that relates to it.

    A category relates when it equals the intent code, when the code continues
    it after an underscore, or when the category's name starts with the code.
    Both prefix relations are spelt out as keys, so this is an equi-join; an
    intent without a category goes under its own code. Only distinct codes are
    routed, and their rows then look the category up.
    """
    routed = route_codes(intents.select("intent_code").distinct(), lexicon)
    return intents.select("row_no", "intent_code", "intent", "email").join(routed, "intent_code").select(
        "row_no", "intent_code", "intent", "email", "category", "cat_no"
    )


def route_codes(codes: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(intent_code, category, cat_no) of distinct ``codes(intent_code)``."""
    code, cat = F.col("intent_code"), F.col("code")
    heads = F.filter(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.char_length(code), F.lit(1))),
            lambda i: F.when(
                F.substring(code, i, F.lit(1)) == "_", F.substring(code, F.lit(1), i - 1)
            ),
        ),
        lambda head: head.isNotNull(),
    )
    wanted = codes.select(
        "intent_code",
        F.explode(
            F.concat(
                F.transform(F.array_append(heads, code), lambda k: F.struct(F.lit("name").alias("kind"), k.alias("key"))),
                F.array(F.struct(F.lit("start").alias("kind"), code.alias("key"))),
            )
        ).alias("want"),
    ).select("*", "want.kind", "want.key").drop("want")
    starts = F.transform(
        F.sequence(F.lit(0), F.char_length(cat)), lambda i: F.substring(cat, F.lit(1), i)
    )
    offered = (
        categories(lexicon)
        .select(
            "code", "cat_no",
            F.explode(
                F.concat(
                    F.array(F.struct(F.lit("name").alias("kind"), cat.alias("key"))),
                    F.transform(starts, lambda k: F.struct(F.lit("start").alias("kind"), k.alias("key"))),
                )
            ).alias("offer"),
        )
        .groupBy("offer.kind", "offer.key")
        .agg(F.min(F.struct("cat_no", "code")).alias("category"))
    )
    return (
        wanted.join(offered, ["kind", "key"], "left")
        .groupBy("intent_code")
        .agg(F.min("category").alias("category"))
        .select(
            "intent_code",
            F.coalesce("category.code", "intent_code").alias("category"),
            F.col("category.cat_no").alias("cat_no"),
        )
    )


def first_per_code(intents: DataFrame) -> DataFrame:
    """(intent_code, row_no, intent, email): the first row of each intent code."""
    return intents.groupBy("intent_code").agg(
        F.min(F.struct("row_no", "intent", "email")).alias("first")
    ).select("intent_code", "first.row_no", "first.intent", "first.email")


def terms_in_file_order(lexicon: DataFrame, n: int) -> DataFrame:
    """The first ``n`` terms of each category, repeats included."""
    order = W.partitionBy("code").orderBy("row_no")
    return (
        lexicon.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= n)
        .select("code", "place", "term", "row_no")
    )
