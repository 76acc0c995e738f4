"""How often each run of words stands in a text, counted within the text.

Every text is one row, so its runs are counted in the task that reads it, and what
leaves the task is one row per text and distinct run, however often the run occurs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Words that are counted together; a longer text is counted by itself.
MOST_WORDS = 1 << 20


def counted(texts: DataFrame, lengths: Sequence[int], known: Sequence[str] | None = None) -> DataFrame:
    """(guid, gram, times): the runs of words of ``texts(guid, words)``, of each of the lengths.

    A run is its words parted by single spaces. It is counted from the left, and places
    that overlap a place counted before do not count. The work is linear in the words.
    With ``known`` words, runs that hold any other are left out.
    """
    lengths = sorted(set(lengths))
    known = None if known is None else sorted(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = None if known is None else pa.array(known, pa.string())
        for batch in batches:
            for guids, words in _parts(batch.column("guid"), batch.column("words")):
                for rows, grams, times in _counts(words, lengths, listed):
                    yield pa.RecordBatch.from_arrays([guids.take(rows), grams, times], names=["guid", "gram", "times"])

    kind = texts.schema["guid"].dataType.simpleString()
    return texts.select("guid", "words").mapInArrow(run, f"guid {kind}, gram string, times bigint")


def _parts(guids: pa.Array, words: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + MOST_WORDS, side="right")))
        yield guids[start:stop], words[start:stop]
        start = stop


def _counts(
    words: pa.Array, lengths: Sequence[int], known: pa.Array | None
) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """(rows, grams, times) for each of the ascending lengths."""
    coded = words.flatten().dictionary_encode()
    ids, spelling = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    rows, base = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes), len(spelling)
    wanted = np.ones(base, bool) if known is None else pc.is_in(spelling, value_set=known).to_numpy(zero_copy_only=False)
    here = wanted[ids]
    asked = here
    # The runs of one word less as numbers, by place, and the words of each such number.
    codes, spelt = np.zeros(len(ids), np.int64), []
    for n in range(1, max(lengths, default=0) + 1):
        places = len(ids) - n + 1
        if places <= 0:
            return
        last = ids[n - 1 :]
        asked = asked[:places] & here[n - 1 :]
        if n in lengths:
            whole = asked & (rows[:places] == rows[n - 1 :])
            # Below 2 to the 62nd, as there are few rows where there are many words.
            heads = max(1, len(spelt[0])) if spelt else 1
            keys = (rows[:places] * heads + codes[:places]) * base + last
            found, times = np.unique(keys[whole & ~_overlapping(keys, whole, n)], return_counts=True)
            rest, tail = np.divmod(found, base)
            row, head = np.divmod(rest, heads)
            parts = [spelling.take(pa.array(w[head])) for w in spelt] + [spelling.take(pa.array(tail))]
            grams = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
            yield pa.array(row), grams, pa.array(times.astype(np.int64))
        if n == 1:
            codes, spelt = ids, [np.arange(base)]
        elif n < max(lengths):
            runs, codes = np.unique(codes[:places] * base + last, return_inverse=True)
            head, tail = np.divmod(runs, base)
            spelt = [w[head] for w in spelt] + [tail]


def _overlapping(keys: np.ndarray, whole: np.ndarray, n: int) -> np.ndarray:
    """The places of runs of ``n`` words that begin within an earlier counted place of the same run."""
    near, dropped = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    for d in range(1, min(n, len(keys))):
        same = (keys[:-d] == keys[d:]) & whole[d:]
        near[:-d] |= same
        near[d:] |= same
    places = np.flatnonzero(near)
    if n == 2 and len(places):
        # One word over and over: every second place of the stretch.
        begins = np.concatenate([[True], (np.diff(places) > 1) | (np.diff(keys[places]) != 0)])
        first = np.maximum.accumulate(np.where(begins, places, 0))
        dropped[places[(places - first) % 2 == 1]] = True
        return dropped
    until: dict[int, int] = {}
    for place, key in zip(places.tolist(), keys[places].tolist(), strict=True):
        if place < until.get(key, 0):
            dropped[place] = True
        else:
            until[key] = place + n
    return dropped
