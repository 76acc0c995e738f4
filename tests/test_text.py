import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from postroom.functions import text
from postroom.functions.charsets import case_variants, regex_ranges


def apply(spark, step, *values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    rows = df.select("i", step(F.col("t")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


CLEANED = {
    "From: a\rb\nTo: x\nkept": "kept",
    "x -- Original Message -- y\nz": "x y z",
    "a\x1cb\x0bc\xa0d": "a b c d",
    "I <3 you > me &lt;b&gt; &amp;nbsp; ok": "i me b nbsp ok",
    "see HTTP://A http://b.c/d www.x a@b.c": "see http a",
    "Auto: hi": "au",
    "½ ﬁ ™ ß Ø": "fi tm",
    "café naïve 你ok": "cafe naive ok",
    "Bcc: x": "b",
    "one\nbcc: two\nthree": "one b three",
    "a___b__c": "ab c",
    "a\x1fb@c d": "a d",
    "": "",
    "  42 !! ": "",
}


def test_clean_text_on_edge_rows(spark):
    assert apply(spark, text.clean_text, *CLEANED) == list(CLEANED.values())


def test_clean_text_takes_null_as_empty(spark):
    assert apply(spark, text.clean_text, None, "x") == ["", "x"]


def test_words_are_those_of_the_cleaned_text(spark):
    words = apply(spark, text.clean_words, *CLEANED)
    assert [" ".join(w) for w in words] == list(CLEANED.values())


def test_every_character_folds_as_its_decomposition(spark):
    chars = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    blocks = ["x".join(chars[i : i + 2000]) for i in range(0, len(chars), 2000)]
    expected = [
        "".join(c for c in unicodedata.normalize("NFKD", b) if c < "\x80") for b in blocks
    ]
    assert apply(spark, text.ascii_fold, *blocks) == expected


def test_case_variants_are_what_ignore_case_equates():
    for variant, first in case_variants().items():
        assert re.fullmatch(re.escape(first), variant, re.IGNORECASE), (variant, first)
    assert case_variants()["ſ"] == "s"
    assert case_variants()["ı"] == "i"


def test_ranges_cover_their_characters():
    body = regex_ranges("ıſﬁ\U0001f100", gap=1)
    assert body == r"\x{131}-\x{131}\x{17F}-\x{17F}\x{FB01}-\x{FB01}\x{1F100}-\x{1F100}"


def test_entities_are_replaced_in_order(spark):
    got = apply(spark, text.strip_html, "&amp;nbsp; &amp;lt; <p\n>x</p><>")
    assert got == ["&nbsp; <  x <>"]


@pytest.mark.parametrize(
    "line, kept",
    [
        ("a From: x To: y", "a "),
        ("subject: x\r\nb", "\nb"),
        ("-- q -- original message -- z ---", ""),
        ("a --Original Message", "a --Original Message"),
        ("--\n-- original message --\n--", "--\n\n--"),
        ("__ ____ _____", "__  "),
    ],
)
def test_headers(spark, line, kept):
    assert apply(spark, text.strip_headers, line) == [kept]


def test_long_rulers_and_unbroken_runs_stay_cheap(spark):
    ruler, blob = "-" * 200_000 + "\n", "x" * 200_000 + " a@b"
    assert apply(spark, text.strip_headers, ruler) == [ruler]
    assert apply(spark, text.strip_html, "a<b>" + "<" * 300_000) == ["a " + "<" * 300_000]
    assert apply(spark, text.strip_html, "<" * 300_000 + "x>é<") == [" é<"]
    assert apply(spark, text.clean_text, "x" * 500_000 + " -- y") == ["x" * 500_000 + " y"]
    assert apply(spark, text.strip_addresses, blob) == ["x" * 200_000 + "  "]


def test_addresses(spark):
    got = apply(spark, text.strip_addresses, "a@b", "@b", "a@", "@@", "@@x", "a@b@ c", "(a@b)")
    assert got == [" ", "@b", "a@", "@@", " ", "  c", " "]


def test_prompt_field_strips_then_cuts(spark):
    got = apply(spark, lambda c: text.prompt_field(c, 3), "　\x1c abcd ", None)
    assert got == ["abc", ""]


def test_weighted_text_keeps_its_joints(spark):
    df = spark.createDataFrame([("", "b"), ("s", ""), ("s t", "b")], "s string, b string")
    got = [r[0] for r in df.select(text.weighted_text(F.col("s"), F.col("b"))).collect()]
    assert got == ["  b", "s s ", "s t s t b"]
