"""Matching by shuffle, against matching by broadcast."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from postroom.operators import large_lexicon, matching
from postroom.operators.staging import Staging

WORDS = ["a", "bb", "the", "of", "dog", "cat", "tree", "blue"]


def made_up(spark, seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["the", *WORDS]) for _ in range(n))
    mail = [(str(i), rng.choice([None, text(3)]), text(rng.choice([0, 5, 60]))) for i in range(80)]
    terms = [(i, f"C{i % 4}", text(rng.choice([1, 1, 2, 2, 3, 4]))) for i in range(60)]
    terms += [(99, "C1", "the the"), (100, "C2", "never seen"), (101, "C2", "e-bill"), (102, "C3", terms[0][2])]
    return (
        spark.createDataFrame(mail, "guid string, subject string, body string"),
        spark.createDataFrame(terms, "row_no int, code string, term string").withColumn("cat_no", F.col("row_no")),
    )


@pytest.mark.parametrize("seed, hot", [(1, 10_000), (2, 5)])
def test_equal_to_broadcast(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(large_lexicon, "HOT_SHARE", hot)
    mail, lexicon = made_up(spark, seed)
    want = matching.keyphrase_counts(mail, lexicon, passes=1)
    got = matching.keyphrase_counts_shuffled(mail, lexicon)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_lexicon_of_many_shares_is_shuffled(spark):
    mail, lexicon = made_up(spark, 3)
    # Terms that can overlap themselves are counted by pattern, apart from the others.
    lexicon = lexicon.where("size(array_distinct(split(term, ' '))) = size(split(term, ' '))")
    got = matching.keyphrase_counts(mail, lexicon, passes=matching.MOST_SHARES + 1)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("BroadcastHashJoin") <= 2
    want = matching.keyphrase_counts(mail, lexicon, passes=1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_nothing(spark):
    mail, lexicon = made_up(spark, 4)
    assert matching.keyphrase_counts_shuffled(mail, lexicon.limit(0)).collect() == []
    assert matching.keyphrase_counts_shuffled(mail.limit(0), lexicon).collect() == []


def test_filter(spark):
    staging = Staging(spark)
    keys = spark.range(3_000).select(F.xxhash64("id").alias("hash"))
    bits = large_lexicon.filter_bits(3_000)
    vector = staging.written(large_lexicon.key_filter(keys, bits), "filter").scalar()
    asked = spark.range(30_000).select("id", large_lexicon.may_hold(vector, F.xxhash64("id"), bits).alias("held"))
    held = {r.id for r in asked.where("held").collect()}
    assert set(range(3_000)) <= held and len(held) < 3_000 + 0.01 * 27_000
    assert large_lexicon.filter_bits(10**9) == large_lexicon.MOST_BITS
    none = staging.written(large_lexicon.key_filter(keys.limit(0), 1024), "filter").scalar()
    assert spark.range(50).where(large_lexicon.may_hold(none, F.xxhash64("id"), 1024)).count() == 0


def test_a_message_meets_a_term_once(spark, tmp_path):
    mail = spark.createDataFrame([("1", "dog", "dog cat " * 300), ("2", None, "dog")], "guid string, subject string, body string")
    lexicon = spark.createDataFrame([(1, "A", "dog"), (2, "B", "dog"), (3, "B", "cat dog")], "row_no int, code string, term string")
    staging = Staging(spark, str(tmp_path))
    got = matching.keyphrase_counts_shuffled(mail, lexicon, staging)
    rows = {(r.guid, r.code, r.term): r.n for r in got.collect()}
    assert rows == {("1", "A", "dog"): 302, ("1", "B", "dog"): 302, ("1", "B", "cat dog"): 299, ("2", "A", "dog"): 1, ("2", "B", "dog"): 1}
    # Of message 1 four runs of words at most, not 600 places; and no list of categories moves with a message.
    assert spark.read.parquet(f"{staging.path}/passed-*").count() <= 5
    assert "Exchange hashpartitioning(guid" not in got._jdf.queryExecution().executedPlan().toString()
