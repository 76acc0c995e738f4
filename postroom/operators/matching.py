"""Dictionary matching: which terms occur in which message, and how often.

A text becomes an array of words. Keyphrases are looked up among its distinct runs
of words, counted in the task that reads the text. For the rules each position
yields the word with its successor, phrases are looked up by their first two words in
one equi-join, and the rest of a longer one is compared in place. So the work per
position does not grow with the lexicon, and no pair of message and term is formed
that shares no words.

The terms are broadcast. A lexicon too large for one broadcast is broadcast in
shares by the hash of its keys, which the words run past one after the other: the
text is read, cleaned and taken apart once, and its words are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.functions.text import (
    clean_text,
    clean_words,
    fold_case_variants,
    has_no_case_variant,
    match_text,
    text_or_empty,
    weighted_text,
)
from postroom.operators import counting, large_lexicon
from postroom.operators.dimensions import categories
from postroom.operators.sizing import broadcast_passes
from postroom.operators.staging import Staging

# A phrase occurrence counts double; mean hit lengths are
# measured against five letters.
PHRASE_WEIGHT = 2
USUAL_LENGTH = 5

# Shares of a lexicon that an executor holds together, each at most one broadcast.
MOST_SHARES = 8
# Words of a lexicon that tasks know, so that runs of others are not looked up; with more, all are.
MOST_KNOWN = 10_000

_WORD = r"[\p{L}\p{N}_]"
_OTHER = r"[^\p{L}\p{N}_]"
# Anything between two words other than one single space.
_GAP = rf"{_OTHER}(?:{_OTHER}+|(?<! ))"
_GAP_MARK = "\n"


def with_gaps_marked(text: Column) -> Column:
    """Words parted by single spaces; any other separator becomes a word of its own."""
    return F.regexp_replace(text, _GAP, f" {_GAP_MARK} ")


def _whole_word_pattern(term: Column) -> Column:
    """Word boundaries as explicit classes, which mean the same whatever the engine's ``\\b``."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    # A boundary beside a non-word character asks for a word character outside.
    # The literal comes first, so that the search can skip along the text.
    after = F.when(term.rlike(rf"{_WORD}$"), rf"(?!{_WORD})").otherwise(rf"(?={_WORD})")
    before = F.when(term.rlike(rf"^{_WORD}"), rf"(?<!{_WORD}").otherwise(rf"(?<={_WORD}")
    return F.concat(quoted, after, before, quoted, F.lit(")"))


def _overlaps_itself(words: Column) -> Column:
    """Does some proper head of the word list equal its tail?"""
    n = F.size(words)
    return F.when(
        n > 1,
        F.exists(
            F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
            lambda k: F.slice(words, F.lit(1), k) == F.slice(words, n - k + 1, k),
        ),
    ).otherwise(F.lit(False))


def _longest(words: Column) -> Column:
    return F.element_at(
        F.array_sort(F.transform(words, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w")))), -1
    )["w"]


def _keyed(terms: DataFrame, spelling: Column, countable: Column, once: Column) -> DataFrame:
    """Add how each distinct term is looked up.

    ``countable`` terms are their words and nothing else: each place where the
    words line up is an occurrence. Any other term, and one that can overlap
    itself, is looked up by its longest word among the distinct words of the text,
    and counted there by its pattern. ``once`` terms are looked up there too, and
    count for one however often they occur.
    """
    words = F.filter(F.split(with_gaps_marked(spelling), " "), lambda w: w != "")
    real = F.filter(F.col("words"), lambda w: w != _GAP_MARK)
    by_pattern = ~F.col("once") & (~countable | _overlaps_itself(F.col("words")))
    return (
        terms.withColumn("words", words)
        .withColumn("once", once)
        .withColumn("by_pattern", by_pattern)
        .withColumn("n", F.size("words"))
        .withColumn("distinct", F.col("once") | F.col("by_pattern"))
        .withColumn(
            "key",
            F.when(F.col("once"), spelling)
            .when(F.col("by_pattern"), F.when(F.size(real) > 0, _longest(real)).otherwise(_GAP_MARK))
            .otherwise(F.get("words", F.lit(0))),
        )
        .withColumn("second", F.when(~F.col("distinct"), F.get("words", F.lit(1))))
        .withColumn("hash", _key_hash(F.col("distinct"), F.col("key"), F.col("second")))
        .withColumn("spelling", spelling)
        .withColumn("pattern", F.when(F.col("by_pattern"), _whole_word_pattern(spelling)))
        .drop("words", "by_pattern")
    )


def _key_hash(distinct: Column, word: Column, following: Column) -> Column:
    """64 bits of one or two words, apart for places and for distinct words; a null is skipped."""
    return F.xxhash64(F.when(distinct, F.lit(1)).otherwise(F.lit(0)), word, following)


def _shared_out(rows: DataFrame, dim: DataFrame, key: str, passes: int) -> DataFrame:
    """Inner join with a dimension that one broadcast may not hold.

    It is broadcast in shares by its key, so a row finds its matches in one of them;
    the rows run past all shares in one go, and are neither read again nor shuffled.
    """
    if passes == 1:
        return rows.join(F.broadcast(dim), key)
    values = [c for c in dim.columns if c != key]
    share = F.pmod(F.xxhash64(key), F.lit(passes))
    found = rows
    for i in range(passes):
        part = dim.where(share == i).select(
            F.col(key).alias(f"_{key}{i}"), F.struct(F.lit(True).alias("hit"), *values).alias(f"_share{i}")
        )
        found = found.join(F.broadcast(part), F.col(key) == F.col(f"_{key}{i}"), "left")
    first = F.coalesce(*[F.col(f"_share{i}") for i in range(passes)])
    return (
        found.withColumn("_found", first)
        .where("_found.hit")
        .select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in values])
    )


def _occurrences(
    texts: DataFrame, keyed: DataFrame, text: Column, passes: int
) -> DataFrame:
    """Rows of (guid, term, times) for ``texts(guid, words, once_words, pattern_words)``.

    A term yields one row per occurrence, or one row with its count, perhaps zero,
    where it is counted by pattern in ``text``. Callers sum ``times`` and then drop
    the zeros; a filter here would count every pattern twice. The join is on a
    64-bit hash, several times cheaper to look up than a string, and every match
    is confirmed on the strings. Behind the words of a text come its distinct
    words, for the terms that are looked up once: first those before case variants
    were evened out, then, if these differ, those after. The work is linear in the text.
    """
    place, size = F.col("pos") + 1, F.size("words")
    at_place = F.col("pos") < size
    second = F.when(at_place, F.get("words", place))
    # The outer form, as the plain form would have the optimizer evaluate the words
    # a second time, in a filter beneath the scan; a row without a word has no key.
    words = F.concat("words", "once_words", "pattern_words")
    keys = texts.select("*", F.posexplode_outer(words).alias("pos", "word")).withColumn("second", second)
    one = _key_hash(~at_place, F.col("word"), F.lit(None).cast("string"))
    two = _key_hash(F.lit(False), F.col("word"), F.col("second"))
    keys = keys.withColumn(
        "hash", F.when(~at_place, one).when(F.col("second").isNotNull(), two)
    )
    dim = keyed.withColumnRenamed("second", "key2")
    lined_up = (F.col("n") <= 2) | (
        F.array_join(F.slice("words", place, F.col("n")), " ") == F.col("spelling")
    )
    same = F.col("word") == F.col("key")
    of_once = F.col("pos") < size + F.size("once_words")
    # Without case variants the distinct words stand once, for both kinds of terms.
    of_pattern = ~of_once | (F.size("pattern_words") == 0)
    # The strings are compared within the branches, where the comparison stays a
    # check of each match and does not widen the join key.
    confirmed = (
        F.when(F.col("once"), same & ~at_place & of_once)
        .when(F.col("pattern").isNotNull(), same & ~at_place & of_pattern)
        .otherwise(same & at_place & (F.col("key2").isNull() | (F.col("key2") == F.col("second"))) & lined_up)
    )
    times = F.when(F.col("pattern").isNull(), F.lit(1)).otherwise(
        F.regexp_count(text, F.col("pattern"))
    )
    return (
        _shared_out(keys, dim, "hash", passes)
        .where(confirmed)
        .select("guid", "term", times.cast("bigint").alias("times"))
    )


def weighted_texts(messages: DataFrame) -> DataFrame:
    """(guid, text): cleaned subject twice, then cleaned body."""
    cleaned = messages.select(
        "guid",
        clean_text(F.col("subject")).alias("subject"),
        clean_text(F.col("body")).alias("body"),
    )
    return cleaned.select("guid", weighted_text(F.col("subject"), F.col("body")).alias("text"))


def weighted_words(messages: DataFrame) -> DataFrame:
    """(guid, words): the words of the weighted text in order."""
    # One cleaning expression for both fields halves the plan.
    fields = F.transform(F.array(*map(text_or_empty, (F.col("subject"), F.col("body")))), clean_words)
    subject, body = F.get("fields", F.lit(0)), F.get("fields", F.lit(1))
    return messages.select("guid", fields.alias("fields")).select(
        "guid", F.concat(subject, subject, body).alias("words")
    )


def keyphrase_counts(
    messages: DataFrame, lexicon: DataFrame, passes: int | None = None, bucketed: bool = False
) -> DataFrame:
    """(guid, cat_no, code, term, n): whole-word occurrences in the weighted text.

    Terms are independent of each other. One with anything but letters and
    single spaces cannot occur in cleaned text and drops out of the join. Each
    distinct term is counted once per message, and only its count meets the
    categories that list it. A lexicon of more than ``MOST_SHARES`` broadcasts is joined by shuffle.
    """
    passes = broadcast_passes(lexicon.select("term").distinct()) if passes is None else passes
    if passes > MOST_SHARES:
        return keyphrase_counts_shuffled(messages, lexicon)
    listed = _countable(lexicon)
    terms = listed.select("term").distinct()
    keyed = terms.withColumn("hash", F.xxhash64("term"))
    counts = (
        _per_message(_same_term(_shared_out(_grams(messages, terms), keyed, "hash", passes)), bucketed)
        .groupBy("guid", "term")
        .agg(F.sum("times").alias("n"))
    )
    passes = max(passes, broadcast_passes(listed)) if passes > 1 else 1
    return _shared_out(counts, listed, "term", passes).select(
        "guid", "cat_no", "code", "term", "n"
    )


def _countable(lexicon: DataFrame) -> DataFrame:
    """(code, term, cat_no) of the terms that cleaned text can hold."""
    return (
        lexicon.where(F.col("term").rlike("^[a-z]+( [a-z]+)*$"))
        .select("code", "term")
        .distinct()
        .join(categories(lexicon), "code")
    )


def _grams(messages: DataFrame, terms: DataFrame) -> DataFrame:
    """(guid, gram, times, hash): the runs of as many words as terms have, in each weighted text."""
    sizes = terms.agg(F.collect_set(F.size(F.split("term", " ")))).first()[0]
    words = terms.select(F.explode(F.split("term", " ")).alias("word")).distinct().limit(MOST_KNOWN + 1).collect()
    known = [r["word"] for r in words] if len(words) <= MOST_KNOWN else None
    return counting.counted(weighted_words(messages), sizes, known).withColumn("hash", F.xxhash64("gram"))


def _same_term(found: DataFrame) -> DataFrame:
    """(guid, term, times) of matches by hash, confirmed on the strings, which so don't widen the join key."""
    same = F.startswith("gram", "term") & F.startswith("term", "gram")
    return found.where(same).select("guid", "term", "times")


def keyphrase_counts_shuffled(
    messages: DataFrame, lexicon: DataFrame, staging: Staging | None = None
) -> DataFrame:
    """``keyphrase_counts`` with terms that are not broadcast, whatever their number.

    What the texts share with the terms is staged, one row per message and term. The categories
    that list a term meet its counts in the join that confirms them, and move with no count.
    """
    staging = Staging(messages.sparkSession) if staging is None else staging
    listed = (
        _countable(lexicon)
        .groupBy("term")
        .agg(F.collect_list(F.struct("cat_no", "code")).alias("listings"))
    )
    # A term's listings are at most the categories.
    keyed = staging.written(listed.withColumn("hash", F.xxhash64("term")), "terms")
    counts = large_lexicon.found(_grams(messages, keyed), keyed, staging)
    return counts.select("guid", F.explode("listings").alias("listed"), "term", "n").select(
        "guid", "listed.cat_no", "listed.code", "term", "n"
    )


def _no_words() -> Column:
    return F.array().cast("array<string>")


def _per_message(hits: DataFrame, bucketed: bool) -> DataFrame:
    """Bring the hits of a message together by its guid alone.

    Whatever is grouped by guid and more, and joined by guid, needs no other shuffle
    of hits after that. Over a table bucketed by guid they are together already.
    """
    return hits if bucketed else hits.repartition("guid")


def keyphrase_json(messages: DataFrame, counts: DataFrame) -> DataFrame:
    """(guid, keyphrase_stats): ``{code: {term: n}}`` of the hits, null without any.

    Guids must not be null. Categories in file order, terms longest first. The lists nested here hold
    at most one entry per term of the lexicon.
    """
    per_category = counts.groupBy("guid", "code").agg(
        F.min("cat_no").alias("cat_no"),
        F.array_sort(
            F.collect_list(F.struct((-F.char_length("term")).alias("longest"), "term", "n"))
        ).alias("terms"),
    )
    per_message = per_category.groupBy("guid").agg(
        F.array_sort(F.collect_list(F.struct("cat_no", "code", "terms"))).alias("hits")
    )
    nested = F.map_from_entries(
        F.transform(
            "hits",
            lambda c: F.struct(
                c["code"],
                F.map_from_entries(
                    F.transform(c["terms"], lambda t: F.struct(t["term"], t["n"]))
                ),
            ),
        )
    )
    stats = per_message.select("guid", F.to_json(nested).alias("keyphrase_stats"))
    return messages.select("guid").join(stats, "guid", "left")


def rule_texts(messages: DataFrame) -> DataFrame:
    """(guid, text, words, raw, once_words, pattern_words) of the uncleaned lower-case text.

    ``raw`` are its words. ``text`` and ``words`` have case variants evened out,
    which hardly any text holds. ``once_words`` are the distinct words of ``raw``, and
    ``pattern_words`` those of ``words`` where they may differ.
    """

    def words(text: str) -> Column:
        return F.split(with_gaps_marked(F.col(text)), " ")

    plain = F.col("plain")
    return (
        messages.select("guid", match_text(F.col("subject"), F.col("body")).alias("lower"))
        .select("*", has_no_case_variant(F.col("lower")).alias("plain"), words("lower").alias("raw"))
        .select(
            "*", F.when(plain, F.col("lower")).otherwise(fold_case_variants(F.col("lower"))).alias("text")
        )
        .select(
            "guid", "text", "plain", F.when(plain, F.col("raw")).otherwise(words("text")).alias("words"), "raw"
        )
        .select(
            "guid", "text", "words", "raw", F.array_distinct("raw").alias("once_words"),
            F.when(plain, _no_words()).otherwise(F.array_distinct("words")).alias("pattern_words"),
        )
    )


def token_set(messages: DataFrame) -> DataFrame:
    """(guid, token): the distinct words made only of a-z and 0-9."""
    return rule_texts(messages).select(
        "guid",
        F.explode(F.filter("once_words", lambda w: w.rlike("^[a-z0-9]+$"))).alias("token"),
    )


def rule_hits(
    messages: DataFrame, terms: DataFrame, passes: int | None = None, bucketed: bool = False
) -> DataFrame:
    """(guid, cat_no, code, term, is_phrase, times, repeats, score), to be summed.

    ``terms`` is a numbered lexicon. A single word scores one per listing
    however often it occurs; each occurrence of a phrase scores double.
    A term listed twice counts twice.
    """
    passes = broadcast_passes(terms.select("term").distinct()) if passes is None else passes
    term, is_phrase = F.col("term"), F.contains(F.col("term"), F.lit(" "))
    spelling = F.when(is_phrase, fold_case_variants(term)).otherwise(term)
    matchable = terms.where(is_phrase | term.rlike("^[a-z0-9]+$"))
    keyed = _keyed(
        matchable.select("term").distinct(),
        spelling,
        spelling.rlike(rf"^{_WORD}+( {_WORD}+)*$"),
        once=~is_phrase,
    )
    listed = matchable.select("term", "cat_no", "code", "mult")
    found = _per_message(
        _occurrences(rule_texts(messages), keyed, F.col("text"), passes), bucketed
    )
    passes = max(passes, broadcast_passes(listed)) if passes > 1 else 1
    hits = _shared_out(found, listed, "term", passes)
    repeats = F.col("times") * F.col("mult")
    return hits.select(
        "guid", "cat_no", "code", "term", is_phrase.alias("is_phrase"), "times",
        repeats.alias("repeats"),
        F.when(is_phrase, repeats * PHRASE_WEIGHT).otherwise(repeats).alias("score"),
    )


def category_scores(hits: DataFrame, mode: str = "count") -> DataFrame:
    """(guid, cat_no, code, score) with a positive score.

    ``weighted`` scales by the mean length of the hits, repeats included, and
    drops what truncates to zero.
    """
    length = F.col("repeats") * F.char_length("term")
    totals = hits.groupBy("guid", "code").agg(
        F.min("cat_no").alias("cat_no"),
        F.sum("score").alias("score"),
        F.sum(length).alias("letters"),
        F.sum("repeats").alias("repeats"),
    )
    if mode == "weighted":
        mean = F.try_divide("letters", "repeats")
        score = F.floor(F.col("score") * (mean / F.lit(float(USUAL_LENGTH)))).cast("bigint")
    elif mode == "count":
        score = F.col("score")
    else:
        raise ValueError(f"mode must be 'count' or 'weighted', not {mode!r}")
    return totals.select("guid", "cat_no", "code", score.alias("score")).where(F.col("score") > 0)


def keyword_hits(hits: DataFrame) -> DataFrame:
    """(guid, code, term, n): how often each term stands in a category's audit list."""
    return (
        hits.groupBy("guid", "code", "term")
        .agg(F.min("cat_no").alias("cat_no"), F.sum("repeats").alias("n"))
        .where(F.col("n") > 0)
        .select("guid", "cat_no", "code", "term", "n")
    )
