"""Runs of words counted within a text, against patterns over the text."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from postroom.operators import counting, matching


def by_pattern(words, n):
    text = " ".join(words)
    grams = {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
    return {g: len(re.findall(rf"(?<!\w){g}(?!\w)", text)) for g in grams}


@pytest.mark.parametrize("most, lengths", [(1 << 20, [1, 2]), (16, [1, 2, 3, 4]), (1, [3]), (50, [2, 5])])
def test_equal_to_patterns(spark, monkeypatch, most, lengths):
    monkeypatch.setattr(counting, "MOST_WORDS", most)
    rng = random.Random(most)
    texts = [[rng.choice(["a", "a", "bb", "é"]) for _ in range(rng.choice([0, 1, 5, 40]))] for _ in range(120)]
    rows = [(None if i == 7 else str(i), words) for i, words in enumerate(texts)] + [("none", None)]
    df = spark.createDataFrame(rows, "guid string, words array<string>").coalesce(1)
    got = [(r.guid, r.gram, r.times) for r in counting.counted(df, lengths).collect()]
    want = [
        (guid, gram, n) for guid, words in rows if words for k in lengths for gram, n in by_pattern(words, k).items()
    ]
    assert Counter(got) == Counter(want)


def test_runs_of_known_words(spark):
    words = "a b a b c a a a b a c c b".split()
    df = spark.createDataFrame([("1", words)], "guid string, words array<string>")
    got = {r.gram: r.times for r in counting.counted(df, [1, 2, 3], ["a", "b", "z"]).collect()}
    want = {g: n for k in (1, 2, 3) for g, n in by_pattern(words, k).items() if "c" not in g}
    assert got == want
    assert counting.counted(df, [1, 2], []).collect() == []


@pytest.mark.parametrize("most", [0, 10_000])
def test_known_words_change_no_count(spark, monkeypatch, most):
    monkeypatch.setattr(matching, "MOST_KNOWN", most)
    mail = spark.createDataFrame([("1", "dog", "cat dog dog dog e-bill")], "guid string, subject string, body string")
    lexicon = spark.createDataFrame(
        [(1, "A", "dog"), (2, "B", "cat dog"), (2, "B", "dog dog"), (3, "C", "cow")], "row_no int, code string, term string"
    )
    for counts in (matching.keyphrase_counts(mail, lexicon, 1), matching.keyphrase_counts_shuffled(mail, lexicon)):
        assert {(r.term, r.n) for r in counts.collect()} == {("dog", 5), ("cat dog", 1), ("dog dog", 2)}


def test_nothing_to_count(spark):
    df = spark.createDataFrame([("1", ["a"])], "guid string, words array<string>")
    assert counting.counted(df, []).collect() == []
    assert counting.counted(df, [2]).collect() == []
    assert counting.counted(df.limit(0), [1]).collect() == []


def test_a_message_is_counted_in_the_task_that_reads_it(spark):
    mail = spark.createDataFrame([("1", "", "dog cat " * 300)], "guid string, subject string, body string")
    lexicon = spark.createDataFrame([(1, "A", "dog"), (2, "B", "cat dog")], "row_no int, code string, term string")
    counts = matching.keyphrase_counts(mail, lexicon, passes=1)
    assert {(r.term, r.n) for r in counts.collect()} == {("dog", 300), ("cat dog", 299)}
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression [guid") < plan.index("MapInArrow")


def test_repeated_guids_count_together(spark):
    mail = spark.createDataFrame([("1", "", "dog"), ("1", "", "dog dog")], "guid string, subject string, body string")
    lexicon = spark.createDataFrame([(1, "A", "dog")], "row_no int, code string, term string")
    for counts in (matching.keyphrase_counts(mail, lexicon, 1), matching.keyphrase_counts_shuffled(mail, lexicon)):
        assert [r.n for r in counts.collect()] == [3]
