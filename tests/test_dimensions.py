import pytest

from postroom.operators import dimensions, report


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def _raw_lexicon(spark):
    return spark.createDataFrame(
        [(1, "c1", " Billing ", " Bill "), (2, "c1", "Billing", "bill"), (3, "c2", "Account", "ab"),
         (4, "c2", None, "lost"), (5, "c2", "Account", None), (6, "c2", "Account", "My Account")],
        "row_no int, Category string, Category_Code string, Term string",
    )


def test_lexicon_table_keeps_repeats_and_drops_short_terms(spark):
    rules = dimensions.lexicon_from_table(_raw_lexicon(spark), dimensions.MIN_TERM_LENGTH)
    assert _rows(rules) == [(1, "Billing", "bill"), (2, "Billing", "bill"), (6, "Account", "my account")]
    assert len(_rows(dimensions.lexicon_from_table(_raw_lexicon(spark)))) == 4
    assert _rows(dimensions.numbered(rules)) == [
        (1, "Billing", "bill", 1, 2), (6, "Account", "my account", 6, 1)]


def test_lexicon_columns_fall_back(spark):
    raw = spark.createDataFrame([(1, "Billing", "x", "bill")], "row_no int, ` Category ` string, other string, third string")
    assert _rows(dimensions.lexicon_from_table(raw)) == [(1, "Billing", "bill")]


def test_lexicon_json(spark):
    text = '{"B": {"terms": [" Bill ", "bill", "", "My Bill"]}, "A": {"terms": ["x"]}, "N": {}}'
    got = dimensions.lexicon_from_json(spark.createDataFrame([(0, text)], "row_no int, value string"))
    # A row with a null term stands for each category itself, also one without terms.
    found = {(tuple(r["cat_no"]), r["code"], r["term"]) for r in got.collect()}
    assert got.count() == len(found)
    assert found == {
        ((0, 0), "B", None), ((0, 0), "B", "bill"), ((0, 0), "B", "my bill"),
        ((0, 1), "A", None), ((0, 1), "A", "x"), ((0, 2), "N", None),
    }


def _raw_intents(spark):
    return spark.createDataFrame(
        [(1, " Billing ", " Bill ", " A@X.org "), (2, "Unclassified", "u", "u@x.org"),
         (3, "Billing", "other", "b@x.org"), (4, None, "n", "n@x.org"), (5, "Outage", "o", None),
         (6, "Legal", None, "l@x.org")],
        "row_no int, Intent_Code string, Intent string, Email string",
    )


def test_intents_for_rules_and_for_prompts(spark):
    rules = dimensions.intents_from_table(_raw_intents(spark))
    assert _rows(rules, "row_no", "intent_code", "email", "method") == [
        (1, "Billing", "a@x.org", ""), (2, "Unclassified", "u@x.org", ""),
        (3, "Billing", "b@x.org", ""), (6, "Legal", "l@x.org", "")]
    labelled = dimensions.labelled_intents(_raw_intents(spark))
    assert _rows(labelled, "row_no", "email")[0] == (1, " A@X.org ")
    assert [r[0] for r in dimensions.valid_codes(labelled).collect()] == ["Billing", "Outage", "Unclassified"]
    shots = dimensions.few_shots(labelled, 1).collect()
    assert [(s["row_no"], s["intent"]) for s in shots] == [(1, "Bill")]
    with pytest.raises(ValueError, match="Email"):
        dimensions.labelled_intents(labelled)


def test_routing_takes_the_first_related_category(spark):
    lexicon = spark.createDataFrame(
        [(1, "Bill", "x"), (2, "Billing_BS", "x"), (3, "Account", "x"), (4, "", "x")],
        "row_no int, code string, term string",
    )
    codes = ["Bill", "Bill_DM_X", "Billing_BS", "Billing", "Acc", "Account2", "_x", "Zed", ""]
    intents = spark.createDataFrame(
        [(i, c, c, "e") for i, c in enumerate(codes)],
        "row_no int, intent_code string, intent string, email string",
    )
    routed = {r["intent_code"]: r["category"] for r in dimensions.route_intents(intents, lexicon).collect()}
    assert routed == {
        "Bill": "Bill", "Bill_DM_X": "Bill", "Billing_BS": "Billing_BS", "Billing": "Billing_BS",
        "Acc": "Account", "Account2": "Account2", "_x": "", "Zed": "Zed", "": "Bill",
    }


def test_profile(spark):
    lexicon = dimensions.lexicon_from_table(_raw_lexicon(spark), 3)
    got = report.kb_profile(lexicon, dimensions.intents_from_table(_raw_intents(spark))).first()
    assert got.asDict() == {
        "categories": 2, "terms": 3, "single_word_terms": 1, "phrases": 1,
        "records": 4, "intent_codes": 3, "addresses": 4, "domains": 1}
