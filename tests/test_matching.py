import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postroom.operators import dimensions, matching

TERMS = [
    "bill", "a b", "a a", "a b a", "b a b a", "x", "e-bill", "b-a x", "a  b", "- -", "(a b)", "a\\eb x",
    "a_b x", "café a", "x é", "a b x", "a a a", "last bill", "4 a", "b. a",
    "(last bill", "ι σ", "last",
]


def _messages(spark, bodies):
    rows = [(str(i), None, body) for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, "guid string, subject string, body string")


def _lexicon(spark, terms, code="C"):
    rows = [(i, code, t) for i, t in enumerate(terms, 1)]
    return spark.createDataFrame(rows, "row_no bigint, code string, term string")


def _random_bodies(n, seed=5):
    rng = random.Random(seed)
    words = ["a", "a", "b", "b", "x", "bill", "last", "é", "café", "e-bill", "4", "laſt", "(a", "b)", "-"]
    gaps = [" "] * 12 + ["\n", "-", "_", ".", "", "  ", "\\E", "("]
    return [
        "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 30)))
        for _ in range(n)
    ]


def _found(text, term):
    """Whole-word, non-overlapping occurrences, by trying the pattern on the text."""
    return len(re.findall(rf"\b{re.escape(term)}\b", text, re.IGNORECASE))


ODD = ["x(a b)y (a b)", "x- -y x- - -y", "a\\Eb x a\\eb x", "a_b x", "b. a b. a.", "b a b a b a b a b",
       "a b a b a", "a a a a a a a", "café a café a", "laſt bill", "x(laſt bill x(last bill", "ι ς ι σ", "laſt", "x é xé", "a  b a  b", "b-a x"]


@pytest.mark.parametrize("passes", [1, 3])
def test_rule_hits_equal_brute_force(spark, passes):
    bodies = ODD + _random_bodies(300)
    terms = dimensions.numbered(_lexicon(spark, TERMS))
    hits = matching.rule_hits(_messages(spark, bodies), terms, passes)
    got = {
        (int(r["guid"]), r["term"]): r["n"]
        for r in hits.groupBy("guid", "term").agg(F.sum("times").alias("n")).collect()
        if r["n"]
    }
    expected = {}
    for i, body in enumerate(bodies):
        text = " " + body.lower()
        runs = set(re.findall(r"\w+", text))
        for term in TERMS:
            n = _found(text, term) if " " in term else int(term in runs and term != "e-bill")
            if n:
                expected[i, term] = n
    assert got == expected
    assert {t for _, t in got} == set(TERMS) - {"e-bill"}


@pytest.mark.parametrize("passes", [1, 3])
def test_keyphrase_counts_equal_brute_force(spark, passes):
    rng = random.Random(3)
    texts = [[" ".join(rng.choice("aabx") for _ in range(rng.randint(0, 12))) for _ in "sb"] for _ in range(200)]
    rows = [(str(i), s, b) for i, (s, b) in enumerate(texts)]
    messages = spark.createDataFrame(rows, "guid string, subject string, body string")
    terms = ["a", "a b", "a a", "a b a", "b a b", "x a b", "a a a b", "e-bill", "4", "a  b"]
    counts = matching.keyphrase_counts(messages, _lexicon(spark, terms + ["a"]), passes)
    got = {(r["guid"], r["term"]): r["n"] for r in counts.collect()}
    expected = {
        (str(i), t): n
        for i, (s, b) in enumerate(texts)
        for t in terms
        if (n := _found(f"{s} {s} {b}", t))
    }
    assert got == expected


def test_subject_counts_twice_and_phrases_cross_the_joint(spark):
    messages = spark.createDataFrame([("1", "pay bill", "now")], "guid string, subject string, body string")
    counts = matching.keyphrase_counts(messages, _lexicon(spark, ["bill", "bill pay", "bill now"]))
    assert {r["term"]: r["n"] for r in counts.collect()} == {"bill": 2, "bill pay": 1, "bill now": 1}


def test_repeated_listing_scores_twice_and_words_score_once(spark):
    lexicon = _lexicon(spark, ["bill", "bill", "my bill"])
    hits = matching.rule_hits(
        _messages(spark, ["my bill, your bill, my bill"]), dimensions.numbered(lexicon)
    )
    rows = {r["term"]: (r["times"], r["score"]) for r in hits.groupBy("term").agg(
        F.sum("times").alias("times"), F.sum("score").alias("score")).collect()}
    assert rows == {"bill": (1, 2), "my bill": (2, 4)}


def test_phrase_needs_its_exact_blank(spark):
    hits = matching.rule_hits(
        _messages(spark, ["my\nbill", "my  bill", "my bill_x", "Amy bill", "my bill"]),
        dimensions.numbered(_lexicon(spark, ["my bill"])),
    )
    assert [r["guid"] for r in hits.collect()] == ["4"]


def test_weighted_scores_truncate_and_drop(spark):
    lexicon = spark.createDataFrame(
        [(1, "Short", "abc"), (2, "Long", "reconciliation"), (3, "Long", "abcde fg")],
        "row_no bigint, code string, term string",
    )
    hits = matching.rule_hits(
        _messages(spark, ["abc reconciliation abcde fg"]), dimensions.numbered(lexicon)
    )
    scores = {r["code"]: r["score"] for r in matching.category_scores(hits, "weighted").collect()}
    # Short: 1 * 3/5 truncates to nothing. Long: 3 * mean(14, 8)/5 = 6.6.
    assert scores == {"Long": 6}
    with pytest.raises(ValueError):
        matching.category_scores(hits, "other")


def test_keyphrase_json_orders_and_keeps_all_messages(spark):
    messages = spark.createDataFrame(
        [("1", "", "my bill and my account bill"), ("2", "", "nothing")],
        "guid string, subject string, body string",
    )
    lexicon = spark.createDataFrame(
        [(1, "Z", "bill"), (2, "Z", "my bill"), (3, "A", "account")],
        "row_no bigint, code string, term string",
    )
    counts = matching.keyphrase_counts(messages, lexicon)
    got = {r[0]: r[1] for r in matching.keyphrase_json(messages, counts).collect()}
    assert got == {"1": '{"Z":{"my bill":1,"bill":2},"A":{"account":1}}', "2": None}


def test_tokens_are_whole_runs_of_a_to_z_and_digits(spark):
    got = matching.token_set(_messages(spark, ["Bill_x café BI84 a-b 4 4"])).collect()
    assert sorted(r["token"] for r in got) == ["4", "a", "b", "bi84"]


def test_hot_text_and_shuffle_width_do_not_change_counts(spark):
    bodies = ["my bill the the the"] * 300 + _random_bodies(100)
    terms = dimensions.numbered(_lexicon(spark, [*TERMS, "the the", "my bill"]))

    def run(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        hits = matching.rule_hits(_messages(spark, bodies).repartition(5), terms)
        scores = matching.category_scores(hits)
        return Counter((r["guid"], r["code"], r["score"]) for r in scores.collect())

    one, many = run("1"), run("7")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == many and sum(one.values()) >= 300


def test_matching_is_linear_in_the_text(spark):
    """Hits far behind the start of a long text cost no more than those near it."""
    def seconds(words):
        body = "lorem ipsum " * (words // 4) + "und license " * (words // 4)
        messages = _messages(spark, [body]).coalesce(1)
        terms = dimensions.numbered(_lexicon(spark, ["und", "license", "e-bill x"]))
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            matching.rule_hits(messages, terms, 1).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        return best

    seconds(1_000)
    assert seconds(128_000) < 4 * seconds(32_000) + 1
