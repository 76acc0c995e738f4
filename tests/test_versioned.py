"""The table in buckets: what an update rewrites, and what a run that dies leaves."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from postroom.operators.queue import apply_predictions
from postroom.operators.versioned import BucketedTable

AT, LATER = "2024-06-01 12:00:00", "2024-06-02 12:00:00"
SCHEMA = "guid string, date timestamp, `odd name` string, predicted string, predicted_date timestamp"


@pytest.fixture
def messages(spark):
    return spark.range(300).select(
        F.col("id").cast("string").alias("guid"), F.lit(None).cast("timestamp").alias("date"),
        F.concat(F.lit("x"), "id").alias("odd name"), F.when(F.col("id") % 2 == 0, "Billing").alias("predicted"),
        F.lit(None).cast("timestamp").alias("predicted_date"),
    )


def batch(spark, *rows):
    return spark.createDataFrame([(g, p, i) for i, (g, p) in enumerate(rows)], "guid string, predicted string, seq int")


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def files_of(table):
    return {b: sorted(os.listdir(f"{folder}/_bucket={b}")) for b, folder in table.folders().items()
            if os.path.isdir(f"{folder}/_bucket={b}")}


@pytest.fixture
def table(messages, tmp_path):
    return BucketedTable.create(messages, f"{tmp_path}/mail", buckets=16)


def test_created(spark, messages, table):
    assert table.read().columns == messages.columns
    assert rows(table.read()) == rows(messages)
    with pytest.raises(ValueError, match="already"):
        BucketedTable.create(messages, table.path)


def test_an_upsert_rewrites_touched_buckets_only(spark, messages, table):
    before, folders = files_of(table), table.folders()
    new = batch(spark, ("7", "Legal"), ("7", "Account"), ("no such guid", "Legal"), (None, "Legal"), ("8", None))
    touched = table.upsert(new, AT)
    assert 1 <= len(touched) <= 3
    assert rows(table.read()) == rows(apply_predictions(messages, new, AT))
    after = files_of(table)
    for b in before:
        assert (after[b] == before[b] and table.folders()[b] == folders[b]) == (b not in touched)


def test_the_log_counts_before_and_after_it_is_merged(spark, messages, table):
    first, second = batch(spark, ("1", "Legal"), ("2", "Legal")), batch(spark, ("2", "Account"), ("250", "Account"))
    want = apply_predictions(apply_predictions(messages, first, AT), second, LATER)
    before = files_of(table)
    assert (table.log(first, AT), table.log(second, LATER)) == (1, 2)
    assert files_of(table) == before and rows(table.read()) == rows(want)
    touched = table.compact()
    assert rows(table.read()) == rows(want) and table.compact() == set()
    assert {b for b, names in files_of(table).items() if names != before[b]} == touched
    table.log(batch(spark, ("1", "Misc")), "2024-06-03 00:00:00")
    assert table.read().where("guid = '1'").first().predicted == "Misc"
    gone = table.vacuum()
    assert any("batch=2" in g for g in gone) and not any("batch=3" in g for g in gone)
    assert table.read().where("guid = '1'").first().predicted == "Misc"
    assert table.read().where("guid = '2'").first().predicted == "Account"


def test_an_upsert_comes_after_what_was_logged(spark, table):
    table.log(batch(spark, ("5", "Legal")), AT)
    table.upsert(batch(spark, ("5", "Account")), LATER)
    assert table.read().where("guid = '5'").first().predicted == "Account"


@pytest.mark.parametrize("step", ["_write", "_swap"])
def test_a_run_that_dies_before_the_swap_changes_nothing(spark, messages, table, monkeypatch, step):
    real = getattr(BucketedTable, step)

    def dies(self, *given):
        if step == "_write":
            real(self, *given)
        raise RuntimeError("lost")

    table.log(batch(spark, ("9", "Legal")), AT)
    before, seen = files_of(table), rows(table.read())
    monkeypatch.setattr(BucketedTable, step, dies)
    for change in (table.compact, lambda: table.upsert(batch(spark, ("5", "Legal")), AT)):
        with pytest.raises(RuntimeError):
            change()
    monkeypatch.undo()
    assert files_of(table) == before and rows(table.read()) == seen
    assert table.vacuum() and rows(table.read()) == seen
    table.upsert(batch(spark, ("5", "Legal")), LATER)
    assert table.read().where("guid = '5'").first().predicted == "Legal"


def test_readers_hold_on_to_their_version(spark, messages, table):
    old = table.read()
    table.upsert(batch(spark, ("5", "Legal")), AT)
    assert rows(old) == rows(messages)


def test_nothing(spark, messages, tmp_path):
    table = BucketedTable.create(messages.limit(0), f"{tmp_path}/empty", buckets=4)
    assert table.read().collect() == [] and table.read().columns == messages.columns
    assert table.compact() == set()
    assert table.upsert(batch(spark, ("1", "Legal")), AT) and table.read().collect() == []
