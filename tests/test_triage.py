import pytest
from pyspark.sql import functions as F

from postroom.operators import predict, report, triage
from postroom.plans import jobs

LEXICON = [
    (1, "Billing", "bill"), (2, "Billing", "invoice"), (3, "Account", "account details"),
    (4, "Account", "address"), (5, "Undeliverable", "delivery failed"), (6, "Orphan", "orphan"),
]
INTENTS = [
    (1, "Billing", "Billing", "business@util.example.com"),
    (2, "Billing_DM", "Demand", "demand@util.example.com"),
    (3, "Billing_DM", "Demand", "second@util.example.com"),
    (4, "Account", "Account", "business@util.example.com"),
    (5, "Undeliverable", "Bounce", "no-reply@util.example.com"),
    (6, "Help", "Help", "helpdesk@util.example.com"),
    (7, "Other", "Other", "helpdesk@util.example.com"),
    (8, "Help", "Help", "helpdesk@util.example.com"),
]
# Hand-made messages, and the decision worked out for each in exact mode.
MESSAGES = [
    ("exact", "My bill is too high", "Invoice bi84, case 3188.", "business@util.example.com"),
    ("two", "Bill query", "My bill is wrong. New address, see account details.", " BUSINESS@util.example.com "),
    ("bounce", "Undeliverable: Re: query", "Mail delivery failed.", "no-reply@util.example.com"),
    ("recipient", "Hello", "Please help.", "helpdesk@util.example.com"),
    ("no_to", "my bill", "", None),
    ("empty_to", "my bill", "", ""),
    ("blank_to", "my bill", "", "  "),
    ("stranger", "my bill", "", "x@elsewhere.example.org"),
    ("neighbour", "my bill", "", "x@util.example.com"),
    ("second", "my bill", "", "second@util.example.com"),
    ("within", "my bill", "", "a@x; demand@util.example.com"),
    ("orphan", "orphan", None, "business@util.example.com"),
    ("none", "Hi", "there", "x@elsewhere.example.org"),
]
EXACT = {
    "exact": ("keyword+email_exact", "high", ["Billing"]),
    "two": ("keyword+email_exact", "high", ["Account", "Billing"]),
    "bounce": ("keyword+email_exact", "high", ["Undeliverable"]),
    "recipient": ("email_only", "medium", ["Help", "Other"]),
    "no_to": ("keyword_only", "medium", ["Billing", "Billing_DM"]),
    "empty_to": ("keyword_only", "medium", ["Billing", "Billing_DM"]),
    "blank_to": ("keyword_only", "medium", ["Billing", "Billing_DM"]),
    "stranger": ("keyword_only", "medium", ["Billing", "Billing_DM"]),
    "neighbour": ("keyword_only", "medium", ["Billing", "Billing_DM"]),
    "second": ("keyword_only", "medium", ["Billing", "Billing_DM"]),
    "within": ("keyword_only", "medium", ["Billing", "Billing_DM"]),
    "orphan": ("keyword_no_intent", "high", ["Unclassified"]),
    "none": ("unmatched", "low", ["Unclassified"]),
}
DOMAIN = EXACT | {
    "exact": ("keyword+email_domain", "high", ["Billing", "Billing_DM"]),
    "two": ("keyword+email_domain", "high", ["Account", "Billing", "Billing_DM"]),
    "bounce": ("keyword+email_domain", "high", ["Undeliverable"]),
    "neighbour": ("keyword+email_domain", "high", ["Billing", "Billing_DM"]),
    "second": ("keyword+email_domain", "high", ["Billing", "Billing_DM"]),
    "within": ("keyword+email_domain", "high", ["Billing", "Billing_DM"]),
}
FUZZY = EXACT | {
    "exact": ("keyword+email_fuzzy", "high", ["Billing"]),
    "two": ("keyword+email_fuzzy", "high", ["Account", "Billing"]),
    "bounce": ("keyword+email_fuzzy", "high", ["Undeliverable"]),
    "blank_to": ("keyword+email_fuzzy", "high", ["Billing", "Billing_DM"]),
    "within": ("keyword+email_fuzzy", "high", ["Billing_DM"]),
}


def tables(spark):
    lexicon = spark.createDataFrame(LEXICON, "row_no int, Category_Code string, Term string")
    intents = spark.createDataFrame(INTENTS, "row_no int, Intent_Code string, Intent string, Email string")
    return lexicon, intents


@pytest.fixture(scope="module")
def rules(spark):
    return triage.Rules.load(*tables(spark))


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(MESSAGES, "guid string, subject string, body string, to string")


def _decisions(df):
    return {r["guid"]: (r["match_source"], r["confidence"], list(r["final_intents"])) for r in df.collect()}


@pytest.mark.parametrize("mode, expected", [("exact", EXACT), ("domain", DOMAIN), ("fuzzy", FUZZY)])
def test_every_branch(rules, messages, mode, expected):
    assert _decisions(triage.triage(messages, rules, mode)) == expected


def test_shuffled_dimensions_decide_alike(rules, messages):
    large = triage.Rules(rules.lexicon, rules.intents, passes=2, small=False)
    assert _decisions(triage.triage(messages, large)) == EXACT


def test_lists_and_storage(rules, messages):
    decided = triage.triage(messages, rules)
    two = decided.where("guid = 'two'").first()
    # Account: a phrase (2) and a word (1). Billing: a word (1).
    assert two["matched_categories"] == ["Account", "Billing"]
    assert two["candidate_intents"] == ["Account", "Billing", "Billing_DM"]
    stored = {r["guid"]: r["predicted"] for r in triage.stored(decided).collect()}
    assert stored["two"] == "Account,Billing"
    none = decided.where("guid = 'none'").first()
    assert none["matched_categories"] == [] and none["candidate_intents"] == []


def test_audit_map_lists_repeats(spark, rules):
    messages = spark.createDataFrame(
        [("1", "bill bill", "account details, account details", None), ("2", "hi", "", None)],
        "guid string, subject string, body string, to string",
    )
    got = triage.with_keyword_hits(triage.triage(messages, rules), rules.hits(messages))
    hits = {r["guid"]: r["keyword_hits"] for r in got.collect()}
    assert hits == {
        "1": {"Billing": ["bill"], "Account": ["account details", "account details"]}, "2": {}}


def test_unknown_mode_is_an_error(rules, messages):
    with pytest.raises(ValueError):
        triage.triage(messages, rules, "sound")


def test_predictor_answers_only_the_unmatched(rules, messages):
    def open_predictor():
        @predict.one_by_one
        def answer(prompt):
            assert "hi there" in prompt.lower(), prompt
            return 'Sure {"intent_codes": ["Nope", "Other", "Billing", "Other"]}'

        return answer

    decided = _decisions(jobs.with_predictor(messages, rules, open_predictor))
    assert decided == EXACT | {"none": ("llm_fallback", "low", ["Other", "Billing", "Other"])}


def test_failing_predictor_leaves_unclassified(rules, messages):
    def open_predictor():
        @predict.one_by_one
        def answer(prompt):
            raise RuntimeError("down")

        return answer

    decided = _decisions(jobs.with_predictor(messages, rules, open_predictor))
    assert decided == EXACT | {"none": ("llm_fallback", "low", ["Unclassified"])}


def test_reports(rules, messages):
    decided = triage.triage(messages, rules)
    first = report.source_breakdown(decided).collect()
    assert [(r["match_source"], r["n"]) for r in first] == [
        ("keyword_only", 7), ("keyword+email_exact", 3), ("email_only", 1),
        ("keyword_no_intent", 1), ("unmatched", 1)]
    assert abs(sum(r["pct"] for r in first) - 100) < 1e-9
    assert report.multi_intent(decided).first().asDict() == {"multi": 9, "total": 13}


def test_hot_recipient_and_copies(spark, rules):
    rows = [(str(i), "my bill", "invoice", "helpdesk@util.example.com") for i in range(500)]
    hot = spark.createDataFrame(rows, "guid string, subject string, body string, to string")
    decided = triage.triage(hot, rules)
    assert decided.where(F.col("match_source") == "keyword_only").count() == 500
