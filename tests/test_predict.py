

import pytest

from postroom.operators import predict, prompts, report

RESPONSES = {
    'ok {"intent": "Bill", "intent_code": "Billing"} bye': ("Bill", "Billing"),
    '{"intent": "x", "intent_code": "bILLING"}': ("x", "Billing"),
    '{"intent": "x", "intent_code": "Nope"}': ("Unclassified", "Unclassified"),
    "{'intent_code': 'Billing'}": ("Unclassified", "Unclassified"),
    '{"intent": null, "intent_code": " Legal "}': ("None", "Legal"),
    '{"intent_code": "Legal"}': ("", "Legal"),
    '{"intent": false, "intent_code": "Legal"}': ("False", "Legal"),
    '{"intent": 12, "intent_code": "Legal"}': ("12", "Legal"),
    '{"intent": " a\\n ", "intent_code": "legal"}': ("a", "Legal"),
    '{"intent_code": "Billing", "intent_code": "Legal"}': ("", "Legal"),
    '{"a": {"intent": "n", "intent_code": "Legal"}}': ("n", "Legal"),
    '{"intent_code": "Billing",}': ("Unclassified", "Unclassified"),
    "no json": ("Unclassified", "Unclassified"),
    "": ("Unclassified", "Unclassified"),
}


def _codes(spark, *codes):
    return spark.createDataFrame([(c,) for c in codes], "intent_code string")


def _responses(spark, raws):
    return spark.createDataFrame(list(enumerate(raws)), "guid int, raw string")


def test_responses(spark):
    parsed = predict.parse_responses(_responses(spark, RESPONSES), _codes(spark, "Billing", "Legal"))
    got = [(r["predicted_intent"], r["predicted_code"]) for r in parsed.orderBy("guid").collect()]
    assert got == list(RESPONSES.values())


def test_case_only_match_takes_the_first_in_order(spark):
    raws = ['{"intent_code": "AB"}', '{"intent_code": "ab"}', '{"intent_code": "aB"}']
    parsed = predict.parse_responses(_responses(spark, raws), _codes(spark, "ab", "Ab", "aB"))
    assert [r["predicted_code"] for r in parsed.orderBy("guid").collect()] == ["Ab", "ab", "aB"]


def test_fallback_answers(spark):
    raws = {
        '{"intent_codes": ["B", "x", "A", "B"]}': ["B", "A", "B"],
        '{"intent_codes": []}': ["Unclassified"],
        '{"intent_codes": "A"}': ["Unclassified"],
        '{"other": 1}': ["Unclassified"],
        "broken": ["Unclassified"],
        "text {'intent_codes': ['A']}": ["Unclassified"],
    }
    got = predict.parse_fallback(_responses(spark, raws), _codes(spark, "A", "B", "A"))
    assert [r["final_intents"] for r in got.orderBy("guid").collect()] == list(raws.values())


def test_failures_go_to_the_error_table(spark):
    def open_predictor():
        opened = {"n": 0}

        @predict.one_by_one
        def answer(prompt):
            opened["n"] += 1
            if "bad" in prompt:
                raise ValueError("cannot read")
            return prompt.upper()

        return answer

    rows = [("1", "good"), ("2", "bad"), ("3", "fine")]
    outcomes = predict.predict(spark.createDataFrame(rows, "guid string, prompt string"), open_predictor)
    assert {(r["guid"], r["raw"]) for r in predict.predictions(outcomes).collect()} == {("1", "GOOD"), ("3", "FINE")}
    assert [tuple(r) for r in predict.errors(outcomes).collect()] == [("2", "cannot read")]
    assert report.run_totals(outcomes).first().asDict() == {"predicted": 2, "errors": 1}


def test_user_prompt(spark):
    df = spark.createDataFrame([(" s%s ", "b" * 1300, None)], "subject string, body string, from string")
    got = df.select(prompts.user_prompt()).first()[0]
    assert got == (
        "Classify this email.\n\nFrom: \nSubject: s%s\nBody:\n" + "b" * 1200
        + '\n\nReturn JSON only: {"intent": "...", "intent_code": "..."}'
    )


def test_context_and_full_prompt(spark):
    lexicon = spark.createDataFrame(
        [(i, "B", f"t{i}") for i in range(1, 26)] + [(30, "A", "a")], "row_no int, code string, term string")
    intents = spark.createDataFrame(
        [(1, "B", "Bill", "b@x"), (2, "A", "Acc", None)],
        "row_no int, intent_code string, intent string, email string")
    context = prompts.context_block(lexicon, intents, "a shop")
    text = context.first()["context"]
    assert "  B: " + ", ".join(f"t{i}" for i in range(1, 21)) + "\n  A: a\n" in text
    assert "\nA | B\n" in text and "for a shop." in text
    assert "  Sender: b@x\n  -> Intent: Bill  |  Code: B\n" in text
    message = spark.createDataFrame([("1", "s", "b", "f")], "guid string, subject string, body string, from string")
    full = prompts.full_prompts(message, context).first()["prompt"]
    assert full.startswith("<s>[INST] " + text + "\n\nClassify this email.") and full.endswith(" [/INST]")


def test_wording_of_the_caller(spark):
    lexicon = spark.createDataFrame(
        [(i, "B", f"t{i}") for i in range(1, 5)], "row_no int, code string, term string")
    intents = spark.createDataFrame(
        [(1, "B", "Bill", "b@x"), (2, "A", "Acc", None)],
        "row_no int, intent_code string, intent string, email string")
    wording = prompts.Wording(
        message="%s|%s|%s", context="100 % of %s: %s / %s / %s", fallback="%s? %s", opening="<", closing=">",
        terms_per_category=2)
    context = prompts.context_block(lexicon, intents, "%s", wording)
    text = "100 % of %s:   B: t1, t2 / A | B /   Sender: b@x\n  -> Intent: Bill  |  Code: B"
    assert context.first()["context"].startswith(text)
    message = spark.createDataFrame([("1", "s", "b%s", "f")], "guid string, subject string, body string, from string")
    full = prompts.full_prompts(message, context, wording).first()["prompt"]
    assert full.startswith("<" + text) and full.endswith("\n\nf|s|b%s>")
    rest = spark.createDataFrame([("1", "words %s")], "guid string, carried string")
    assert prompts.fallback_prompts(rest, intents, wording).first()["prompt"] == "<B | A? words %s>"
    for wrong in ({"message": "%s"}, {"context": ""}, {"fallback": "%s%s%s"}):
        with pytest.raises(ValueError, match="places to fill"):
            prompts.Wording(**wrong)


def test_distribution(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "predicted_code string")
    assert [tuple(r) for r in report.intent_distribution(df).collect()] == [("b", 2), ("a", 1), ("c", 1)]


def test_prompts_come_in_batches_and_a_failed_batch_is_asked_singly(spark):
    rows = [(str(i), f"p{i}") for i in range(10)]

    def open_predictor():
        def answer(prompts):
            if "p7" in prompts:
                raise RuntimeError("out of luck")
            return [f"{p} of {len(prompts)}" for p in prompts]

        return answer

    asked = spark.createDataFrame(rows, "guid string, prompt string").coalesce(1)
    got = {r["guid"]: (r["raw"], r["error"]) for r in predict.predict(asked, open_predictor, batch=4).collect()}
    want = {str(i): (f"p{i} of {4 if i < 4 else 1 if i < 8 else 2}", None) for i in range(10)}
    assert got == {**want, "7": (None, "out of luck")}


def test_too_few_answers_are_errors(spark):
    asked = spark.createDataFrame([("1", "a"), ("2", "b")], "guid string, prompt string").coalesce(1)
    outcomes = predict.predict(asked, lambda: lambda prompts: ["only one"][: 2 - len(prompts)])
    assert {(r["guid"], r["raw"]) for r in outcomes.collect()} == {("1", "only one"), ("2", "only one")}
