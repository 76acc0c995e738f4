import json

import pytest

from postroom.operators import predict, staging
from postroom.plans import jobs
from postroom.sources import files
from tests.test_triage import EXACT, MESSAGES, tables

AT = "2024-06-01 12:00:00"


def _mail(spark):
    rows = [(*m, None, f"2024-01-{i:02d} 00:00:00") for i, m in enumerate(MESSAGES, 1)]
    df = spark.createDataFrame(rows, "guid string, subject string, body string, to string, predicted string, date string")
    return df.selectExpr("*", "'a@b' AS `from`", "CAST(NULL AS timestamp) AS predicted_date")


def test_keyphrase_job(spark, tmp_path):
    with open(tmp_path / "mail.csv", "w") as f:
        f.write('Id,[Subject],Body\n1,My Bill,"bill é\nTo: x"\n2,,\n3,nothing,here\n')
    with open(tmp_path / "terms.json", "w") as f:
        json.dump({"Billing": {"terms": ["Bill", "my bill", "bill my"]}, "None": {"terms": []}, "Rest": {"terms": ["zebra"]}}, f)
    outcome = jobs.keyphrase_job(spark, str(tmp_path / "mail.csv"), str(tmp_path / "terms.json"))
    back = files.read_table(spark, str(tmp_path / "mail_with_keyphrases.parquet"))
    assert back.columns == ["Id", "[Subject]", "Body", "keyphrase_stats"]
    stats = {r["Id"]: r["keyphrase_stats"] for r in back.collect()}
    # "my bill my bill bill e"
    assert stats == {"1": '{"Billing":{"bill my":1,"my bill":2,"bill":3}}', "2": None, "3": None}
    summary = {r["code"]: (r["matched"], round(r["pct"], 1)) for r in outcome.reports["match_summary"].collect()}
    assert summary == {"Billing": (1, 33.3), "None": (0, 0.0), "Rest": (0, 0.0)}
    outcome.staging.drop()
    with pytest.raises(Exception):
        outcome.results.count()
    keyed = jobs.keyphrase_job(
        spark, str(tmp_path / "mail.csv"), str(tmp_path / "terms.json"), str(tmp_path / "out.csv"), key="Id")
    assert keyed.results.count() == 3
    assert files.read_table(spark, str(tmp_path / "out.csv")).columns == back.columns


def test_delimited_mail_is_taken_apart_once(spark, tmp_path):
    mail = tmp_path / "mail.csv"
    mail.write_text('Id,[Subject], Body,"no\nte"\n1,bill,"a\nbill",x\n2,,,NA\n')
    (tmp_path / "terms.json").write_text('{"Billing": {"terms": ["bill"]}}')
    outcome = jobs.keyphrase_job(spark, str(mail), str(tmp_path / "terms.json"), str(tmp_path / "out.parquet"), key="Id")
    assert spark.read.parquet(f"{outcome.staging.path}/input-*").count() == 2
    # What is read later reads the staged rows.
    mail.unlink()
    assert [(r["matched"], r["pct"]) for r in outcome.reports["match_summary"].collect()] == [(1, 50.0)]
    back = files.read_table(spark, str(tmp_path / "out.parquet"))
    assert sorted(map(tuple, back.collect())) == [("1", "bill", "a\nbill", "x", '{"Billing":{"bill":3}}'), ("2", None, None, None, None)]
    assert back.columns == ["Id", "[Subject]", " Body", "no\nte", "keyphrase_stats"]


def test_rules_job_and_store(spark, tmp_path):
    mail = _mail(spark)
    outcome = jobs.rules_job(mail, *tables(spark))
    got = {r["guid"]: (r["match_source"], r["confidence"], r["final_intents"]) for r in outcome.results.collect()}
    assert got == EXACT
    after = jobs.store(mail, outcome, AT, str(tmp_path / "after"))
    assert {r["guid"]: r["predicted"] for r in after.collect()} == {g: ",".join(d[2]) for g, d in EXACT.items()}
    # What stayed unclassified is the next run's queue.
    again = jobs.rules_job(after, *tables(spark), n=1)
    assert [r["guid"] for r in again.results.collect()] == ["none"]
    assert outcome.reports["multi_intent"].first()["total"] == len(MESSAGES)


def test_predictor_job(spark, tmp_path):
    def open_predictor():
        @predict.one_by_one
        def answer(prompt):
            if "Hello" in prompt:
                raise RuntimeError("no answer")
            code = "billing" if "bill" in prompt.split("Classify this email.")[1] else "Nope"
            return f'{{"intent": "x", "intent_code": "{code}"}}'

        return answer

    mail = _mail(spark)
    outcome = jobs.predictor_job(mail, *tables(spark), open_predictor, "a shop")
    codes = {r["guid"]: r["predicted_code"] for r in outcome.results.collect()}
    assert codes["exact"] == "Billing" and codes["none"] == "Unclassified" and "recipient" not in codes
    assert [tuple(r) for r in outcome.errors.collect()] == [("recipient", "no answer")]
    assert outcome.reports["run_totals"].first().asDict() == {"predicted": 12, "errors": 1}
    first = outcome.reports["intent_distribution"].first()
    assert (first["predicted_code"], first["n"]) == ("Billing", 9)
    after = jobs.store(mail, outcome, AT, str(tmp_path / "after"))
    assert after.where("predicted IS NULL").count() == 1
    few = jobs.predictor_job(mail, *tables(spark), open_predictor, "a shop", n=2)
    assert {r["guid"] for r in few.results.collect()} == {"none", "orphan"}


def test_the_input_is_never_written_to(spark, tmp_path):
    path = str(tmp_path / "in.parquet")
    spark.createDataFrame([("1", "bill", "x")], "Id string, Subject string, Body string").write.parquet(path)
    (tmp_path / "terms.json").write_text('{"Billing": {"terms": ["bill"]}}')
    for output in (path, path + "/", f"file://{path}", f"{path}/inside.parquet", str(tmp_path), f"{tmp_path}/x/../in.parquet"):
        with pytest.raises(ValueError, match="overlaps"):
            jobs.keyphrase_job(spark, path, str(tmp_path / "terms.json"), output, key="Id")
    assert [tuple(r) for r in files.read_table(spark, path).collect()] == [("1", "bill", "x")]
    jobs.keyphrase_job(spark, path, str(tmp_path / "terms.json"), key="Id")
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        jobs.keyphrase_job(spark, path, str(tmp_path / "terms.json"), key="Id")


def test_repeated_keys_are_an_error(spark, tmp_path):
    mail = _mail(spark).where("guid = 'exact'")
    with pytest.raises(ValueError, match="guid must be unique"):
        jobs.rules_job(mail.unionByName(mail), *tables(spark))
    path = str(tmp_path / "in.parquet")
    spark.createDataFrame([("1", "bill", "x")] * 2, "Id string, Subject string, Body string").write.parquet(path)
    (tmp_path / "terms.json").write_text('{"Billing": {"terms": ["bill"]}}')
    with pytest.raises(ValueError, match="unique"):
        jobs.keyphrase_job(spark, path, str(tmp_path / "terms.json"), str(tmp_path / "out.parquet"), key="Id")
    assert not (tmp_path / "out.parquet").exists()


def test_a_message_without_guid_is_decided_like_others(spark):
    mail = _mail(spark).where("guid = 'exact'")
    nameless = mail.selectExpr("CAST(NULL AS string) AS guid", *[f"`{c}`" for c in mail.columns if c != "guid"])
    got = jobs.rules_job(nameless.unionByName(mail), *tables(spark)).results.collect()
    assert {r["guid"] for r in got} == {None, "exact"}
    assert len({(r["match_source"], tuple(r["matched_categories"])) for r in got}) == 1


def test_staging_goes_where_all_executors_reach(spark, tmp_path):
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.sql.warehouse.dir": "hdfs://nn:8020/warehouse/"})

    assert staging.shared_folder(Session) == "hdfs://nn:8020/warehouse/staging"
    Session.conf["spark.checkpoint.dir"] = "s3a://bucket/shared"
    assert staging.shared_folder(Session) == "s3a://bucket/shared"
    own = staging.Staging(spark, str(tmp_path / "own"))
    assert own.written(spark.range(3), "x").count() == 3 and len(list((tmp_path / "own").iterdir())) == 1
    own.drop()
    assert not list((tmp_path / "own").iterdir())


def test_dry_run_shows_source_and_confidence(spark, tmp_path):
    mail = _mail(spark)
    outcome = jobs.rules_job(mail, *tables(spark), staging_folder=str(tmp_path / "staged"))
    shown = jobs.store(mail, outcome, AT, str(tmp_path / "after"), dry_run=True)
    assert shown.columns == ["guid", "predicted", "match_source", "confidence"]
    got = {r["guid"]: (r["match_source"], r["confidence"], r["predicted"].split(",")) for r in shown.collect()}
    assert got == EXACT
    assert not (tmp_path / "after").exists() and (tmp_path / "staged").exists()
