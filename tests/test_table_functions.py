import pytest

from postroom.operators import predict, table_functions

ASKED = "organisation string, guid string, prompt string, extra int"
SQL = "SELECT * FROM asked_of_tests(TABLE({asked}) PARTITION BY (organisation, part))"


def _table(spark, rows):
    return spark.createDataFrame([(o, g, p, 1) for o, g, p in rows], ASKED)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _upper(organisation):
    def answer(prompts):
        if any(p and "bad" in p for p in prompts):
            raise ValueError("cannot read")
        return [f"{organisation}:{p} of {len(prompts)}" for p in prompts]

    return answer


def _closed(organisation):
    if organisation == "closed":
        raise OSError("no model")
    return predict.one_by_one(lambda prompt: f"{organisation}:{prompt}")


def _asked_from_sql(spark, prompts, open_predictor, rows=100, **options):
    table_functions.register_predictor(spark, "asked_of_tests", open_predictor, **options)
    return spark.sql(SQL, asked=table_functions.parted(prompts, rows))


def test_sql_and_dataframe_give_the_same(spark):
    rows = [(f"o{i % 3}", str(i), f"p{i}") for i in range(500)]
    prompts = _table(spark, rows)
    want = sorted([(o, g, f"{o}:{p}", None) for o, g, p in rows], key=repr)
    assert _rows(_asked_from_sql(spark, prompts, _closed)) == want
    assert _rows(table_functions.predict_by_organisation(prompts, _closed)) == want
    plain = predict.predict(prompts, lambda: predict.one_by_one(str.upper))
    parts = table_functions.predict_by_organisation(prompts, lambda _: predict.one_by_one(str.upper), rows=7)
    assert _rows(parts.select("guid", "raw", "error")) == _rows(plain)


def test_a_predictor_that_does_not_open_fails_its_organisation_only(spark):
    prompts = _table(spark, [("closed", "1", "a"), ("closed", "2", "b"), ("open", "3", "c"), (None, "4", "d")])
    assert _rows(_asked_from_sql(spark, prompts, _closed)) == sorted(
        [
            ("closed", "1", None, "no model"), ("closed", "2", None, "no model"),
            ("open", "3", "open:c", None), (None, "4", "None:d", None),
        ],
        key=repr,
    )


def test_batches_are_full_across_arriving_rows(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        prompts = _table(spark, [("o", str(i), f"p{i}") for i in range(10)])
        got = [r["raw"].rsplit(" ", 1)[1] for r in _asked_from_sql(spark, prompts, _upper, batch=4).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got) == ["2"] * 2 + ["4"] * 8


def test_nulls_repeats_failures_and_empty_tables(spark):
    prompts = _table(spark, [("o", None, "p"), ("o", "1", None), ("o", "1", "x"), ("o", "1", "x"), ("o", "2", "bad")])
    got = table_functions.predict_by_organisation(prompts, _upper, batch=2)
    rows = got.collect()
    assert len(rows) == 5 and [(r["guid"], r["error"]) for r in rows if r["error"]] == [("2", "cannot read")]
    assert {(r["guid"], r["raw"].split(" ")[0]) for r in rows if r["raw"]} == {(None, "o:p"), ("1", "o:None"), ("1", "o:x")}
    assert table_functions.predict_by_organisation(prompts.limit(0), _upper).collect() == []
    assert got.columns == ["organisation", "guid", "raw", "error"]


def test_a_large_organisation_has_several_parts(spark):
    rows = [("hot", str(i), "p") for i in range(1000)] + [(None, str(i), "p") for i in range(250)] + [("small", "1", "p")]
    parted = table_functions.parted(_table(spark, rows), rows=100)
    counts = {(r["organisation"], r["part"]): r["count"] for r in parted.groupBy("organisation", "part").count().collect()}
    assert sum(counts.values()) == len(rows) and max(counts.values()) < 200
    assert {o: len([1 for p in counts if p[0] == o]) for o in ("hot", None, "small")} == {"hot": 10, None: 3, "small": 1}
    assert parted.columns == ["organisation", "guid", "prompt", "extra", "part"]


def test_wrong_tables_raise(spark):
    table_functions.register_predictor(spark, "asked_of_tests", _upper)
    prompts = _table(spark, [("a", "1", "p"), ("b", "2", "p")]).coalesce(1)
    with pytest.raises(Exception, match="not partitioned by organisation"):
        spark.sql("SELECT * FROM asked_of_tests(TABLE({asked}) WITH SINGLE PARTITION)", asked=prompts).collect()
    with pytest.raises(Exception, match="no column prompt"):
        spark.sql(
            "SELECT * FROM asked_of_tests(TABLE({asked}) PARTITION BY organisation)", asked=prompts.drop("prompt")
        ).collect()
