import pytest
from pyspark.sql import functions as F

from postroom.sources import files, jdbc


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def _write(path, text):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


@pytest.mark.parametrize("suffix, sep", [(".csv", ","), (".tsv", "\t"), (".CSV", ",")])
def test_delimited(spark, folder, suffix, sep):
    text = sep.join(["id", "[Subject]", " body "]) + "\n" + sep.join(["1", '"a ""q"" b"', '"two\nlines"']) + "\n"
    text += sep.join(["2", "NA", ""]) + "\n"
    df = files.read_table(spark, _write(f"{folder}/mail{suffix}", text))
    got = [tuple(r) for r in files.as_messages(df, "id").orderBy("guid").collect()]
    assert got == [("1", 'a "q" b', "two\nlines"), ("2", None, None)]


def test_parquet_round_trip(spark, folder):
    df = spark.createDataFrame([("1", "s", "b", {"k": 1})], "guid string, Subject string, Body string, m map<string,int>")
    files.write_enriched(df, f"{folder}/out.parquet")
    assert files.read_table(spark, f"{folder}/out.parquet").collect() == df.collect()


def test_csv_round_trip_keeps_line_ends_and_writes_maps_as_json(spark, folder):
    df = spark.createDataFrame([("1", 'a "q"\nb', {"k": 1})], "guid string, body string, m map<string,int>")
    files.write_enriched(df, f"{folder}/out.csv")
    back = files.read_table(spark, f"{folder}/out.csv")
    assert [tuple(r) for r in back.collect()] == [("1", 'a "q"\nb', '{"k":1}')]


def test_other_suffix_is_an_error(spark):
    with pytest.raises(ValueError, match="xlsx"):
        files.read_table(spark, "mail.xlsx")


def test_columns_are_found_or_listed(spark):
    df = spark.createDataFrame([("a", "b", "c")], "`[SUBJECT]` string, ` Body` string, body string")
    assert files.resolve_message_columns(df) == {"subject": "[SUBJECT]", "body": " Body"}
    with pytest.raises(ValueError, match="No column"):
        files.resolve_message_columns(df.select("body"))


def test_dimension_rows_are_numbered_in_file_order(spark, folder):
    path = _write(f"{folder}/lexicon.csv", "Category,Category_Code,Term\n" + "".join(
        f"c,C{i % 3},term {i}\n" for i in range(500)))
    df = files.read_dimension(spark, path)
    assert df.where(F.concat(F.lit("term "), (F.col("row_no") - 1).cast("string")) == F.col("Term")).count() == 500


def test_enriched_path():
    assert files.enriched_path("s3a://bucket/dir/mail.parquet") == "s3a://bucket/dir/mail_with_keyphrases.parquet"
    assert files.enriched_path("hdfs://nn:8020/a.b/mail") == "hdfs://nn:8020/a.b/mail_with_keyphrases.parquet"
    assert files.enriched_path("/data/mail.v1.csv") == "/data/mail.v1_with_keyphrases.parquet"


def test_backlog_query_pushes_filter_columns_and_limit():
    query = jdbc.backlog_query("[dbo].[Mail]", 10)
    assert query.startswith("SELECT TOP (10) [GUID] AS [guid], [Date] AS [date], [From] AS [from]")
    assert "WHERE (Predicted IS NULL OR Predicted = 'Unclassified') AND (Body IS NOT NULL" in query
    assert query.endswith("ORDER BY [Date] DESC")
    assert jdbc.backlog_query("mail", 5, "ansi").endswith('ORDER BY "Date" DESC FETCH FIRST 5 ROWS ONLY')
    assert "ORDER BY" not in jdbc.backlog_query("mail")
