"""License notices by conditional compression.

Wherever a text has three words of a template in a row, as much of it around them as the
template could fill is a candidate, whatever its lines and paragraphs; candidates that
touch form a block. A block is compressed alone and with each template as a zstandard raw
dictionary; a template that says the same makes it shrink most. Templates are tried
in the order of that reduction, and the first whose wording the block really holds, by a
comparison word by word, names a notice. What stands before and after it is matched again,
until nothing is confirmed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import small_batches, text_of

# Usual wordings of notices, without years and names.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause-addition": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."
    ),
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
}

# Words in a row that make a candidate. A notice as near to its template as WORDING says
# always holds such a run: even of 100 words with 10 missing and 10 put in, four stay together.
RUN = 3
# Least saving for a template to be tried, as a share of its own size; least share of its words
# that a notice holds, in order, with no more than the rest put in between.
REDUCTION, WORDING = 0.2, 0.9
# A template of fewer bytes is too short for its saving to be measured, and is always tried.
LEAST_BYTES = 16
_WORD = re.compile(r"[\w.+-]*\w")


def plain_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def aligned(ours: np.ndarray, words: np.ndarray) -> tuple[int, int, int, int]:
    """(missing, other, start, end) of the place in ``words`` that differs least from all of ``ours``.

    Both are numbers of words; text before and after the place is free. The work is the product of the lengths.
    """
    size, idx = len(words), np.arange(len(words) + 1)
    rows = np.zeros((len(ours) + 1, size + 1), np.int32)
    for i, word in enumerate(ours):
        row = rows[i] + 1
        np.minimum(row[1:], np.where(words == word, rows[i][:-1], row[1:]), out=row[1:])
        rows[i + 1] = np.minimum.accumulate(row - idx) + idx
    i, j = len(ours), int(np.argmin(rows[-1]))
    end, missing, other = j, 0, 0
    while i:
        if j and ours[i - 1] == words[j - 1] and rows[i, j] == rows[i - 1, j - 1]:
            i, j = i - 1, j - 1
        elif rows[i, j] == rows[i - 1, j] + 1:
            i, missing = i - 1, missing + 1
        else:
            j, other = j - 1, other + 1
    return missing, other, j, end


class Matcher:
    """Templates as dictionaries, their words, and the runs of words that make candidates."""

    def __init__(self, templates: dict[str, str], level: int = 9):
        self.words = {name: words for name, text in templates.items() if (words := plain_words(text))}
        self.number = {w: i for i, w in enumerate(sorted({w for words in self.words.values() for w in words}))}
        self.numbers = {name: np.array([self.number[w] for w in words]) for name, words in self.words.items()}
        self.most = {name: int((1 - WORDING) * len(words) + 1e-9) for name, words in self.words.items()}
        self.alone = zstandard.ZstdCompressor(level=level)
        self.size = {name: len(self.alone.compress(self._content(words))) for name, words in self.words.items()}
        self.given = {
            name: zstandard.ZstdCompressor(
                level=level,
                dict_data=zstandard.ZstdCompressionDict(
                    self._content(words), dict_type=zstandard.DICT_TYPE_RAWCONTENT
                ),
            )
            for name, words in self.words.items()
        }
        # Run of words -> (places before it, places from its start on) that a template may fill.
        self.runs: dict[tuple[str, ...], tuple[int, int]] = {}
        for name, words in self.words.items():
            n = min(RUN, len(words))
            for at in range(len(words) - n + 1):
                before, after = self.runs.get(run := tuple(words[at : at + n]), (0, 0))
                most = self.most[name]
                self.runs[run] = max(before, at + most), max(after, len(words) - at + most)
        self.lengths = sorted({len(run) for run in self.runs})
        self.known = lru_cache(maxsize=20_000)(self._notices)

    @staticmethod
    def _content(words: list[str]) -> bytes:
        return (" ".join(words) + " ").encode()

    def ranked(self, words: list[str]) -> list[tuple[float, str]]:
        """(saving as a share of the template's size, template), most bytes saved first; equal ones
        by what they leave unsaid, then by name."""
        content = self._content(words)
        size = len(self.alone.compress(content))
        saved = {name: size - len(given.compress(content)) for name, given in self.given.items()}
        order = sorted(saved, key=lambda n: (-saved[n], abs(len(self.words[n]) - len(words)), n))
        return [(saved[name] / self.size[name], name) for name in order]

    def candidates(self, words: list[str]) -> list[tuple[int, int]]:
        """Blocks of words around runs that a template has, disjoint and in order."""
        if not any(word in self.number for word in words):
            return []
        spans = []
        known = np.array([w in self.number for w in words])
        for n in self.lengths:
            together = np.convolve(known, np.ones(n, int), "valid") == n if len(words) >= n else np.zeros(0, bool)
            for at in np.flatnonzero(together).tolist():
                reach = self.runs.get(tuple(words[at : at + n]))
                if reach:
                    spans.append((max(0, at - reach[0]), min(len(words), at + reach[1])))
        found: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if found and a <= found[-1][1]:
                found[-1] = found[-1][0], max(found[-1][1], b)
            else:
                found.append((a, b))
        return found

    def notices(self, words: list[str]) -> list[tuple[int, int, str, float, int, int]]:
        """(first word, end, template, reduction, missing words, other words) of all notices, in order."""
        return [
            (at + a, at + b, *found) for at, end in self.candidates(words) for a, b, *found in self.known(tuple(words[at:end]))
        ]

    def _notices(self, words: tuple[str, ...]) -> list[tuple]:
        numbers = np.array([self.number.get(w, -1) for w in words])
        found, waiting = [], [(0, len(words))]
        while waiting:
            a, b = waiting.pop()
            match = self._match(list(words[a:b]), numbers[a:b])
            if match:
                found.append((a + match[0], a + match[1], *match[2:]))
                waiting += [(a, a + match[0]), (a + match[1], b)]
        return sorted(found)

    def _match(self, words: list[str], numbers: np.ndarray) -> tuple | None:
        if not words:
            return None
        for reduction, name in self.ranked(words):
            most = self.most[name]
            told = len(self._content(self.words[name])) >= LEAST_BYTES
            if (told and reduction < REDUCTION) or len(words) < len(self.words[name]) - most:
                continue
            missing, other, start, end = aligned(self.numbers[name], numbers)
            if missing <= most and other <= most:
                return start, end, name, reduction, missing, other
        return None


@lru_cache(maxsize=1)
def _matcher(templates: tuple[tuple[str, str], ...]) -> Matcher:
    return Matcher(dict(templates))


def _scanning(templates: tuple[tuple[str, str], ...]) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(templates)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lowered = text.lower()
                found = matcher.notices(_WORD.findall(lowered))
                if not found:
                    continue
                # Lower-casing may change how many characters there are; places are those of the text.
                places = [m.span() for m in _WORD.finditer(text if len(lowered) == len(text) else lowered)]
                for a, b, *notice in found:
                    start, end = places[a][0], places[b - 1][1]
                    rows.append((doc_id, start, end - start, *notice))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
            names = ["doc_id", "start", "length", "license", "reduction", "missing_words", "other_words"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

    return scan


def license_notices(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, start, length, license, reduction, missing_words, other_words) per notice found.

    ``start`` and ``length`` are characters of the whole text, or of its lower-case form in the
    rare case that this has another length. A notice may stand anywhere, also beside other words
    or notices on its line; where templates overlap, the one that explains most names the place.
    A null or empty text holds no notice; a row without an id and repeated rows are
    scanned like any other; templates without a word are never found; other columns
    are ignored; an empty table gives an empty result. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    given = tuple((TEMPLATES if templates is None else templates).items())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(
        _scanning(given),
        "doc_id long, start long, length long, license string, reduction double, missing_words int, other_words int",
    )
