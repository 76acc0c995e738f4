"""Delimited files read split by split, against Spark's reader of whole files."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postroom.sources import delimited, files

NASTY = [
    "plain", "", '"quoted"', '"with ""doubled"" quotes"', '"line\nend"', '"\n"', '"a,b"', 'in"side', 'end"', '"""', '""""',
    '"closed"and more', '"three\nlines\n""here"""', " ", '" blank "', "é", '"ü\n\n\n,"', '"', '""', "5 inch\" x",
]


def whole(spark, path, sep=","):
    reader = spark.read.options(header=True, sep=sep, multiLine=True, quote='"', escape='"')
    return reader.csv(path)


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture
def split(spark):
    """Splits of so many bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}

    def to(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield to
    for n, value in before.items():
        spark.conf.set(n, value)


def written(path, text):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return str(path)


def well_formed(cell):
    """Would a reader of the cell be outside again behind it?"""
    return cell not in ('"', '"""')


@pytest.mark.parametrize("seed, size, end", [(1, 7, "\n"), (2, 23, "\n"), (3, 64, "\r\n"), (4, 1 << 20, "\n"), (5, 40, "\r\n")])
def test_nasty_quoting(spark, tmp_path, split, seed, size, end):
    rng = random.Random(seed)
    cells = [c for c in NASTY if well_formed(c)]
    # Where lines end in two characters, the other reader takes the first end it sees.
    body = "bo\ndy" if end == "\n" else "body"
    lines = [f'id,[Subject],"{body}"'] + [
        f"{i},{rng.choice(cells)},{rng.choice(cells)}" for i in range(120)
    ]
    path = written(tmp_path / "mail.csv", (end if seed != 4 else "\n").join(lines) + ("" if seed == 2 else end))
    want = whole(spark, path)
    split(size)
    got = delimited.read_delimited(spark, path, want.schema)
    assert got.columns == ["id", "[Subject]", body]
    assert got.select("id").distinct().count() == 120
    if end == "\n":
        assert rows(got) == rows(want)
    else:
        # Within cells the other reader may even out line ends.
        even = [F.regexp_replace(F.col(f"`{c}`"), "\r\n", "\n").alias(c) for c in got.columns]
        assert rows(got.select(even)) == rows(want.select(even))


def test_a_quote_that_never_ends(spark, tmp_path, split):
    path = written(tmp_path / "mail.csv", 'a,b\n1,x\n2,"open\n3,y\n4,z')
    split(4)
    got = delimited.read_delimited(spark, path, whole(spark, path).schema).collect()
    assert [r.a for r in got if r.a == "1"] == ["1"] and len(got) == 2


def test_one_cell_over_many_splits(spark, tmp_path, split):
    long = "\n".join(f'line {i} "" , x' for i in range(300))
    path = written(tmp_path / "mail.csv", f'a,b\n1,"{long}"\n2,"{long}"\n3,short\n')
    split(100)
    got = {r.a: r.b for r in delimited.read_delimited(spark, path, whole(spark, path).schema).collect()}
    assert got == {"1": long.replace('""', '"'), "2": long.replace('""', '"'), "3": "short"}


def test_several_files_each_with_a_head(spark, tmp_path, split):
    for i in range(4):
        written(tmp_path / f"part-{i}.csv", f'﻿id,b\n{i},"two\nlines"\n\n{i},y\n' if i else 'id,b\n')
    split(9)
    schema = spark.createDataFrame([], "id string, b string").schema
    got = rows(delimited.read_delimited(spark, f"{tmp_path}", schema))
    assert got == sorted(repr((str(i), b)) for i in (1, 2, 3) for b in ("two\nlines", "y"))


def test_many_tasks_read_one_file(spark, tmp_path, split):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    files.write_enriched(docs.coalesce(1), f"{tmp_path}/out.csv")
    split(200_000)
    back = files.read_table(spark, f"{tmp_path}/out.csv")
    whole_text = docs.select(F.col("doc_id").cast("string"), "lang", F.when(F.col("text") != "", F.col("text")).alias("text"))
    assert rows(back) == rows(whole_text)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert delimited._lines(spark, f"{tmp_path}/out.csv", ",").rdd.getNumPartitions() >= 8


@pytest.mark.parametrize("small", [True, False])
def test_both_joins(spark, tmp_path, split, small):
    path = written(tmp_path / "mail.csv", "a,b\n" + "".join(f'{i},"x\n{i}"\n' for i in range(60)))
    split(50)
    got = delimited.read_delimited(spark, path, whole(spark, path).schema, small=small)
    assert rows(got) == rows(whole(spark, path))


def test_enriched_output_is_read_once(spark):
    from postroom.plans import queries

    plan = queries.all_queries()["enriched_tsv"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_joined(") == 1 and "SortMergeJoin" not in plan


def test_the_number_of_splits_is_bounded_without_reading(spark, tmp_path, split):
    for i in range(3):
        written(tmp_path / f"part-{i}.csv", "a,b\n" + f'{i},"x\n{i}"\n' * 40)
    for size in (50, 1 << 20):
        split(size)
        lines = delimited._lines(spark, str(tmp_path), ",")
        assert delimited._splits(lines).count() <= delimited._splits_at_most(lines)


def test_nothing(spark, tmp_path):
    schema = spark.createDataFrame([], "a string").schema
    assert delimited.read_delimited(spark, written(tmp_path / "x.csv", "a\n"), schema).collect() == []
    assert delimited.read_delimited(spark, written(tmp_path / "y.csv", ""), schema).collect() == []


def test_states():
    rng = np.random.default_rng(1)
    for _ in range(50):
        out_to, in_to = rng.random((2, rng.integers(1, 30))) < 0.5
        for start in (False, True):
            state, want = start, []
            for a, b in zip(out_to, in_to, strict=True):
                state = bool(b if state else a)
                want.append(state)
            assert delimited.states_after(out_to, in_to, start).tolist() == want
