from postroom.operators import triage
from postroom.streaming.incremental import triage_stream
from tests.test_triage import EXACT, MESSAGES, tables


def test_arriving_files_are_decided_once(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    rules = triage.Rules.load(*tables(spark))
    schema = "guid string, subject string, body string, to string"
    for part in (MESSAGES[:5], MESSAGES[5:], []):
        if part:
            spark.createDataFrame(part, schema).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        triage_stream(stream, rules, out, state).awaitTermination(120)
    got = [(r["guid"], (r["match_source"], r["confidence"], r["final_intents"])) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(MESSAGES) and dict(got) == EXACT
