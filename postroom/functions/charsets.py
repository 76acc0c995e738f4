"""Character tables, built by rule from Python's Unicode data on the driver.

They become literals of a Column expression, so executors never need them.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# No code point above this one folds to ASCII or has a case variant.
_LAST_CODE_POINT = 0x1FFFF


def _characters():
    for code_point in range(0x80, _LAST_CODE_POINT + 1):
        if not 0xD800 <= code_point <= 0xDFFF:
            yield chr(code_point)


@lru_cache(maxsize=1)
def ascii_folds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose NFKD form keeps one ASCII character, and those keeping several."""
    single, several = {}, {}
    for char in _characters():
        ascii_part = "".join(c for c in unicodedata.normalize("NFKD", char) if c < "\x80")
        if len(ascii_part) == 1:
            single[char] = ascii_part
        elif ascii_part:
            several[char] = ascii_part
    return single, several


@lru_cache(maxsize=1)
def case_variants() -> dict[str, str]:
    """Lower-case letters that an ignore-case match treats as another one.

    They share an upper-case form: long s and s, dotless i and i, final and
    medial sigma. Each maps to the first of its group, letter to letter, so the
    words of a text stay in place.
    """
    groups: dict[str, list[str]] = {}
    for char in [chr(c) for c in range(0x80)] + list(_characters()):
        if char.lower() == char and char.isalpha():
            groups.setdefault(char.upper(), []).append(char)
    return {c: group[0] for group in groups.values() for c in group[1:]}


@lru_cache(maxsize=1)
def blanks() -> str:
    """Every character that Python's ``str.strip`` removes."""
    ascii_blanks = [chr(c) for c in range(0x80) if chr(c).isspace()]
    return "".join(ascii_blanks + [c for c in _characters() if c.isspace()])


def regex_ranges(chars, gap: int = 8) -> str:
    """A regex class body covering the characters, with near ones joined to ranges.

    The ranges may take in a few characters between; few ranges keep matching fast.
    """
    ranges: list[list[int]] = []
    for code_point in sorted(map(ord, chars)):
        if ranges and code_point - ranges[-1][1] <= gap:
            ranges[-1][1] = code_point
        else:
            ranges.append([code_point, code_point])
    return "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in ranges)
