"""As-of and interval joins, threads, moving counts, roll-ups, sketches and comparisons, against plain loops."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postroom.operators import history, summaries
from postroom.streaming import arrivals

START = datetime(2024, 1, 1)


def when(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_as_of(spark):
    rng = random.Random(1)
    moments = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(20)])) for i in range(60)] + [(0, "a", 3)]
    known = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(0, 40, 3)]), rng.choice([None, "x", "y"]), i % 5) for i in range(40)]
    left = spark.createDataFrame([(i, k, when(t)) for i, k, t in moments], "id int, guid string, at timestamp")
    right = spark.createDataFrame([(k, when(t), v, n) for k, t, v, n in known], "guid string, at timestamp, predicted string, n int")
    want = []
    for i, k, t in moments:
        held = [r for r in known if k is not None and t is not None and r[0] == k and r[1] is not None and r[1] <= t]
        last = max(held, key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3])) if held else (0, 0, None, None)
        want.append((i, k, when(t), last[2], last[3]))
    found = history.as_of(left, right, "guid", "at", ["predicted", "n"])
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert "Join" not in plan(found)
    assert all(r.n is None for r in history.as_of(left, right.limit(0), "guid", "at", ["n"]).collect())


@pytest.mark.parametrize("width", [1, 60])
def test_in_force(spark, width):
    rng = random.Random(2)
    moments = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(0, 5_000, 7)])) for i in range(150)]
    spans = []
    for i in range(120):
        since = rng.choice([None, *range(-500, 5_000, 11)])
        length = rng.choice([0, -5, 1, 60, 61, 500, 100_000, None])
        spans.append((i, rng.choice(["a", "b", None]), since, None if None in (since, length) else since + length))
    left = spark.createDataFrame([(i, k, when(t)) for i, k, t in moments], "id int, kind string, at timestamp")
    right = spark.createDataFrame([(i, k, when(a), when(b)) for i, k, a, b in spans], "no int, kind string, since timestamp, until timestamp")
    found = history.in_force(left, right, ["kind"], "at", "since", "until", width)
    want = [
        (i, n) for i, k, t in moments for n, o, a, b in spans
        if k is not None and k == o and None not in (t, a, b) and a <= t < b
    ]
    assert sorted((r.id, r.no) for r in found.collect()) == sorted(want) and want
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert history.in_force(left, right.limit(0), ["kind"], "at", "since", "until").collect() == []


def mail(spark, seed):
    rng = random.Random(seed)
    # One sender has most of the mail, over many chunks; some are silent for whole chunks.
    rows = [(str(i), rng.choice(["hot", "hot", "hot", "x", None]), rng.choice([None, *range(0, 40_000, 10)])) for i in range(400)]
    rows += [("z1", "hot", 0), ("z2", "hot", 0), ("z3", "once", 10**7)]
    return rows, spark.createDataFrame([(g, s, when(t)) for g, s, t in rows], "guid string, `from` string, date timestamp")


@pytest.mark.parametrize("gap, chunk", [(300, 1_000), (300, 10**8), (20_000, 500), (10, 7)])
def test_threads(spark, gap, chunk):
    rows, df = mail(spark, gap)
    want = []
    by = defaultdict(list)
    for g, s, t in rows:
        if s is not None and t is not None:
            by[s].append((t, g))
    for s, found in by.items():
        found.sort()
        thread = place = 0
        for i, (t, g) in enumerate(found):
            since = t - found[i - 1][0] if i else None
            later = found[i + 1][0] - t if i + 1 < len(found) else None
            thread, place = (thread + 1, 1) if since is None or since >= gap else (thread, place + 1)
            want.append((g, s, thread, place, *(None if x is None else x * 10**6 for x in (since, later))))
    got = history.threads(df, "from", "date", "guid", gap, chunk)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("seconds, chunks", [(60, 1), (600, 3), (100_000, 1)])
def test_moving_counts(spark, seconds, chunks):
    rows, df = mail(spark, 5)
    real = [(g, s, t) for g, s, t in rows if s is not None and t is not None]
    want = [(g, s, sum(o == s and t - seconds <= u <= t for _, o, u in real)) for g, s, t in real]
    got = history.moving_counts(df, "from", "date", "guid", seconds, chunks)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rolled_up(spark):
    rows = [(a, b) for a, b in [("x", 1), ("x", None), (None, 1), (None, None), ("x", 1), ("y", 2)]]
    got = summaries.rolled_up(spark.createDataFrame(rows, "a string, b int"), ["a", "b"])
    want = [(None, None, 0, 6, 1.0)]
    want += [(a, None, 1, n, n / 6) for a, n in Counter(a for a, _ in rows).items()]
    want += [(a, b, 2, n, n / sum(a == x for x, _ in rows)) for (a, b), n in Counter(rows).items()]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_sketches_merge_within_their_error(spark):
    days = spark.range(40_000).select(
        (F.col("id") % 7).alias("day"), (F.col("id") % 3).alias("kind"), F.when(F.col("id") % 5 > 0, F.col("id") * 17 % 20_011).alias("sender")
    )
    stored = summaries.sketches(days, ["day", "kind"], "sender")
    assert stored.count() == 21
    exact = {r.kind: r.n for r in days.groupBy("kind").agg(F.count_distinct("sender").alias("n")).collect()}
    for r in summaries.merged(stored, ["kind"]).collect():
        assert abs(r.distinct - exact[r.kind]) <= 3 * 0.0163 * exact[r.kind]
    assert sum(r.n for r in summaries.merged(stored, ["kind"]).collect()) == 40_000


def test_compared_runs(spark):
    rng = random.Random(3)
    runs = [[(rng.choice(["a", None]), rng.choice([1, 2, None])) for _ in range(n)] for n in (30, 40)]
    before, after = (spark.createDataFrame(r, "source string, n int") for r in runs)
    got = {(r.source, r.n): (r.gone, r.come, r.same) for r in summaries.compared_runs(before, after, ["source", "n"]).collect()}
    b, a = map(Counter, runs)
    assert got == {k: ((b - a)[k], (a - b)[k], (a & b)[k]) for k in {*a, *b}}
    assert sum(r.gone for r in summaries.changes_by(before, after, ["source", "n"], "source").collect()) == (b - a).total()


def test_arrivals(spark, tmp_path):
    """Files out of order, keys delivered again, rows behind the watermark."""
    schema = "guid string, date timestamp, predicted string"
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    parts = [
        [("a", 10, "x"), ("b", 3_700, "x"), ("c", 3_500, "y"), ("n", None, "x")],
        # The watermark is at 100 seconds: "d" comes in time, "late" does not, "b" was there.
        [("d", 200, "x"), ("late", 50, "x"), ("b", 3_700, "x"), ("e", 9_000, "y")],
        [("f", 20_000, "y")],
    ]
    late = 0
    for part in parts:
        spark.createDataFrame([(g, when(t), p) for g, t, p in part], schema).coalesce(1).write.mode("append").parquet(inbox)
        counts = arrivals.windowed_counts(spark.readStream.schema(schema).parquet(inbox), "date", "predicted")
        query = arrivals.store_windows(counts, out, state)
        query.awaitTermination(120)
        late += arrivals.late_rows(query)
    got = sorted((r.start, r.predicted, r.n) for r in spark.read.parquet(out).collect())
    assert got == [(when(0), "x", 2), (when(0), "y", 1), (when(3_600), "x", 1), (when(7_200), "y", 1)]
    assert late == 1
    table = spark.read.schema(schema).parquet(inbox).where("guid != 'late'")
    batch = arrivals.windowed_counts(table, "date", "predicted")
    assert sorted((r.start, r.predicted, r.n) for r in batch.where(F.col("start") < F.lit(when(18_000))).collect()) == got
