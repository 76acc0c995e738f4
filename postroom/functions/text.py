"""Text cleaning as Column expressions. Nothing here leaves the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom.functions.charsets import ascii_folds, blanks, case_variants, regex_ranges

# What counts as markup, mail header, link and address.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
HEADER_NAMES = ["From", "To", "Cc", "Bcc", "Sent", "Subject", "Date"]
ORIGINAL_MESSAGE = "Original Message"
TAG = r"<[^>]+>"
RULE = r"_{3,}"
# Prompt field widths in characters, and the fallback's text width.
SUBJECT_WIDTH, BODY_WIDTH, SENDER_WIDTH, FALLBACK_WIDTH = 300, 1200, 100, 800

# The blanks of ASCII text as a class body; Java's \s lacks \x1c-\x1f.
_BLANK = r" \t-\r\x1c-\x1f"
_LINK_STARTS = ["http", "www."]
_OTHER_BLANKS = "".join(c for c in map(chr, range(0x80)) if c.isspace() and c != " ")
# From the first double dash of a line to its last, when the phrase lies
# between. One attempt per line, so a long ruler of dashes stays cheap.
_QUOTED_RULE = rf"(?idm)^(?>(.*?)--).*{ORIGINAL_MESSAGE}.*--"


def _header_pattern() -> str:
    # A header name ending in another one is cut by the shorter name first and
    # so never matches itself; the others reduce to the earliest on the line.
    names = [
        n.lower()
        for n in HEADER_NAMES
        if not any(n != o and n.lower().endswith(o.lower()) for o in HEADER_NAMES)
    ]
    heads = "".join(sorted({n[0] for n in names}))
    return rf"(?id)(?=[{heads}])(?:{'|'.join(names)}):.*"


def _link_pattern(blank: str) -> str:
    return rf"http[^{blank}]+|www\.[^{blank}]+"


def _address_pattern(blank: str) -> str:
    # A run of non-blanks holding an @ that is neither its first nor its last
    # character. Starting only at the head of a run, and never giving back what
    # comes before the @, keeps this linear on long unbroken runs.
    return rf"(?<![^{blank}])[^{blank}][^{blank}@]*+@[^{blank}]+"


def _bound(col: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate a column once for an expression that needs it several times.

    The variable of a one-element ``transform`` does what a projection would,
    and keeps the result a Column.
    """
    return F.get(F.transform(F.array(col), use), F.lit(0))


def _where_found(col: Column, triggers: list[str], step: Callable[[Column], Column]) -> Column:
    """Apply a step to the texts that hold one of its triggers, and skip the rest."""

    def guarded(text: Column) -> Column:
        found = reduce(or_, [F.contains(text, F.lit(t)) for t in triggers])
        return F.when(found, step(text)).otherwise(text)

    return _bound(col, guarded)


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def is_ascii(col: Column) -> Column:
    return F.octet_length(col) == F.char_length(col)


def strip_blanks(col: Column) -> Column:
    """Trim what Python's ``strip`` trims; Spark's ``trim`` takes spaces only."""
    return F.btrim(col, F.lit(blanks()))


def ascii_fold(col: Column) -> Column:
    """Compatibility-decompose, then drop everything outside ASCII.

    ASCII-only texts pass through untouched, and accented ones are done after
    one translation. Only what is left then is searched for characters that fold
    to more than one letter, which are swapped by a lookup.
    """
    single, several = ascii_folds()
    members = regex_ranges(several)
    swaps = F.from_json(F.lit(json.dumps(several)), "map<string,string>")

    def rest_removed(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(f"[{members}]|[^{members}]+"), F.lit(0))
        swapped = F.array_join(
            F.transform(pieces, lambda p: F.coalesce(F.try_element_at(swaps, p), p)), ""
        )
        beyond_ascii = F.regexp_replace(text, r"[\x00-\x7F]+", "")
        opened = F.when(beyond_ascii.rlike(f"[{members}]"), swapped).otherwise(text)
        return F.when(is_ascii(text), text).otherwise(
            F.regexp_replace(opened, r"[^\x00-\x7F]+", "")
        )

    folded = _bound(F.translate(col, "".join(single), "".join(single.values())), rest_removed)
    return F.when(is_ascii(col), col).otherwise(folded)


def has_no_case_variant(col: Column) -> Column:
    variants = case_variants()
    # The lower bound first: it settles nearly every character with one comparison.
    bound = f"\\x{{{ord(min(variants)):X}}}-\\x{{10FFFF}}"
    return is_ascii(col) | ~col.rlike(f"[{bound}&&[{regex_ranges(variants, gap=1)}]]")


def fold_case_variants(col: Column) -> Column:
    """Bring lower-case text to one form per ignore-case group."""
    table = case_variants()
    return F.translate(col, "".join(table), "".join(table.values()))


def strip_html(col: Column) -> Column:
    def without_tags(t: Column) -> Column:
        # No tag ends after the last ">". Left out there, an unclosed "<" is not
        # searched to the end of the text over and over.
        tail = F.substring_index(t, ">", -1)
        head = F.substring(t, F.lit(1), F.char_length(t) - F.char_length(tail))
        return F.concat(F.regexp_replace(head, TAG, " "), tail)

    col = _where_found(col, ["<"], without_tags)
    for entity, char in ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def strip_headers(col: Column) -> Column:
    """Drop header fields to the end of their line, quoted-mail rules and rulers."""
    col = _where_found(col, [":"], lambda t: F.regexp_replace(t, _header_pattern(), ""))
    col = _where_found(col, ["--"], lambda t: F.regexp_replace(t, _QUOTED_RULE, "$1"))
    return _where_found(col, ["___"], lambda t: F.regexp_replace(t, RULE, ""))


def strip_urls(col: Column, blank: str = _BLANK) -> Column:
    return _where_found(
        col, _LINK_STARTS, lambda t: F.regexp_replace(t, _link_pattern(blank), " ")
    )


def strip_addresses(col: Column, blank: str = _BLANK) -> Column:
    return _where_found(col, ["@"], lambda t: F.regexp_replace(t, _address_pattern(blank), " "))


def letters_only(col: Column) -> Column:
    """Lower-case words parted by single blanks."""
    return F.btrim(F.lower(F.regexp_replace(col, "[^A-Za-z]+", " ")))


def _before_letters(col: Column) -> Column:
    """The cleaning chain up to its last step; the order is part of the result.

    Line ends matter up to the headers. After them one kind of blank is enough,
    which spares the link and address patterns a slow character class.
    """

    def without_links(t: Column) -> Column:
        t = F.translate(t, _OTHER_BLANKS, " " * len(_OTHER_BLANKS))
        return strip_addresses(strip_urls(t, blank=" "), blank=" ")

    col = strip_headers(strip_html(ascii_fold(text_or_empty(col))))
    return _where_found(col, [*_LINK_STARTS, "@"], without_links)


def clean_text(col: Column) -> Column:
    """The whole cleaning chain as a text."""
    return letters_only(_before_letters(col))


def clean_words(col: Column) -> Column:
    """The words of the cleaned text, without building it."""
    return F.regexp_extract_all(F.lower(_before_letters(col)), F.lit("[a-z]+"), F.lit(0))


def weighted_text(clean_subject: Column, clean_body: Column) -> Column:
    """Subject twice, then body; phrases may run across the joints."""
    return F.concat(clean_subject, F.lit(" "), clean_subject, F.lit(" "), clean_body)


def joined_text(subject: Column, body: Column) -> Column:
    return F.concat(text_or_empty(subject), F.lit(" "), text_or_empty(body))


def match_text(subject: Column, body: Column) -> Column:
    """Uncleaned lower-case text for the rule matcher."""
    return F.lower(joined_text(subject, body))


def prompt_field(col: Column, width: int) -> Column:
    return F.substring(strip_blanks(text_or_empty(col)), 1, width)
