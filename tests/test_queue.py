from postroom.operators import queue

SCHEMA = ("guid string, date timestamp, `from` string, to string, subject string, body string,"
          " predicted string, predicted_date timestamp, confirmed string")


def _messages(spark):
    rows = [
        ("a", "2024-01-01 00:00:00", "s", "b", None), ("b", "2024-01-03 00:00:00", "s", None, "Unclassified"),
        ("c", "2024-01-03 00:00:00", None, "b", None), ("d", None, "s", "b", None),
        ("e", "2024-01-05 00:00:00", None, None, None), ("f", "2024-01-06 00:00:00", "s", "b", "Billing"),
        ("g", "2024-01-02 00:00:00", "s", "b", ""),
    ]
    df = spark.createDataFrame(rows, "guid string, date string, subject string, body string, predicted string")
    return df.selectExpr(
        "guid", "CAST(date AS timestamp) AS date", "'f' AS `from`", "'t' AS to", "subject", "body", "predicted",
        "CAST(NULL AS timestamp) AS predicted_date", "'me' AS confirmed")


def test_queue_filters_and_takes_the_newest(spark):
    assert [r["guid"] for r in queue.work_queue(_messages(spark), 3).collect()] == ["b", "c", "a"]
    assert [r["guid"] for r in queue.work_queue(_messages(spark), 9).collect()] == ["b", "c", "a", "d"]
    assert {r["guid"] for r in queue.work_queue(_messages(spark)).collect()} == set("abcd")


def _predictions(spark):
    return spark.createDataFrame(
        [("a", "X", 1), ("a", "Y", 2), ("f", None, 1), ("zz", "Z", 1)], "guid string, predicted string, seq int")


def test_merge_keeps_rows_and_the_last_prediction_wins(spark):
    before = {r["guid"]: r.asDict() for r in _messages(spark).collect()}
    for small in (True, False):
        after = queue.apply_predictions(_messages(spark), _predictions(spark), "2024-06-01 12:00:00", small)
        assert after.columns == _messages(spark).columns
        rows = {r["guid"]: r.asDict() for r in after.collect()}
        assert set(rows) == set(before)
        assert rows["a"]["predicted"] == "Y" and str(rows["a"]["predicted_date"]) == "2024-06-01 12:00:00"
        # A prediction may also clear the field.
        assert rows["f"]["predicted"] is None and rows["f"]["predicted_date"] is not None
        assert all(rows[g] == before[g] for g in set(before) - {"a", "f"})


def test_dry_run_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    shown = queue.write_predictions(_messages(spark), _predictions(spark), "2024-06-01", path, dry_run=True)
    assert {(r["guid"], r["predicted"]) for r in shown.collect()} == {("a", "Y"), ("f", None), ("zz", "Z")}
    assert not (tmp_path / "out").exists()
    written = queue.write_predictions(_messages(spark), _predictions(spark), "2024-06-01", path)
    assert written.count() == 7 and (tmp_path / "out").exists()


def test_a_logged_batch_touches_nothing_written_before(spark, tmp_path):
    log = str(tmp_path / "log")
    messages = _messages(spark)
    queue.log_predictions(_predictions(spark), "2024-06-01 12:00:00", log)
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "log").glob("part-*")}
    later = spark.createDataFrame([("b", "Z", 1), ("a", "W", 1)], "guid string, predicted string, seq int")
    queue.log_predictions(later, "2024-06-02 12:00:00", log)
    after = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "log").glob("part-*")}
    assert before.items() < after.items()
    for small in (None, False):
        rows = {r["guid"]: r for r in queue.with_logged(messages, spark.read.parquet(log), small).collect()}
        assert len(rows) == messages.count()
        assert (rows["a"]["predicted"], str(rows["a"]["predicted_date"])) == ("W", "2024-06-02 12:00:00")
        assert rows["b"]["predicted"] == "Z" and rows["f"]["predicted"] is None
        assert rows["d"]["predicted"] is None and rows["d"]["predicted_date"] is None
