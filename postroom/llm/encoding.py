"""Token ids of whole texts, each distinct word encoded once per worker.

A byte-level BPE with the usual pre-tokenizer pattern never joins what stands on
both sides of a space between two characters that are no white space: a token may
begin with such a space but not hold one further in. So a text is cut there, the
pieces of a batch are made distinct, and the library encodes only pieces the
worker has not met. A text with other white space beside a space takes a slower
path: it is cut before whole runs of white space and those parts are encoded as
they are. Either way the ids are those the library gives for the whole text.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# Pieces a worker remembers, the first it meets; their memory is some 50 bytes each.
MEMO_PIECES = 400_000
# Texts per batch, by bytes: rows are gathered up to this many.
BATCH_BYTES = 4 * 1024 * 1024
# In the slower path a long text is encoded in parts of about this many characters.
PART_CHARS = 32_768

_WHITE = r"\t-\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNSAFE = f"[{_WHITE}] | [{_WHITE}]"


def _byte_alphabet() -> dict[int, str]:
    """How byte-level BPE writes the space and the letters above.

    Bytes that show stand for themselves, the others, in order, for the
    characters from 256 on; a letter is the characters of its UTF-8 bytes.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    written = {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}
    return {c: "".join(written[b] for b in chr(c).encode()) for c in (32, *range(192, 256))}


_ALPHABET = _byte_alphabet()
_CUT = regex.compile(r"(?<=\S)(?=\s)")
# Letters of one or two bytes that every Unicode version calls letters.
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_WORD = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_NOTHING, _SPACE = (pa.scalar(text, pa.large_string()) for text in ("", " "))
_MARKS = '.,!?;:|%$&*#()"'


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer, loaded once per worker, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def safe_parts(text: str, most: int = PART_CHARS) -> Iterator[str]:
    """Cut a text before runs of white space, into parts of about ``most`` characters.

    A text without white space stays whole, however long.
    """
    start = 0
    while len(text) - start > most:
        cut = _CUT.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    ids = np.fromiter((i for row in rows for i in row), np.uint32, int(sizes.sum()))
    return ids, sizes


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the runs [start, start + size) one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(starts - (ends - sizes), sizes)
    shift += np.arange(total)
    return shift


class Encoder:
    """Ids of batches of texts, with a memo of pieces that lasts as long as the worker."""

    def __init__(self, path: str):
        self.library = tokenizer(path)
        before = self.library.pre_tokenizer
        if self.library.normalizer is not None or "ByteLevel(" not in repr(before):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Straight from the library, without begin, end or added special tokens."""
        return _flat(
            [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        )

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters after at most one space: each is one pre-token, so the
        library's model is asked directly, in its alphabet of bytes."""
        model = self.library.model
        return _flat([[t.id for t in model.tokenize(w.translate(_ALPHABET))] for w in words])

    def _learnt(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(pieces in another order, their ids, number of ids of each)."""
        words = pc.match_substring_regex(pieces, _WORD)
        word, rest = pieces.filter(words), pieces.filter(pc.invert(words))
        (a, n), (b, m) = self._words(word.to_pylist()), self._encoded(rest.to_pylist())
        return pa.concat_arrays([word, rest]), np.concatenate([a, b]), np.concatenate([n, m])

    def _looked_up(self, pieces: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """(places of distinct pieces, (ids, starts, sizes) at those places).

        New pieces come after the known ones, and stay while there is room.
        """
        place = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(place))
        found = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        view = self.ids, self.starts, self.sizes
        if len(new):
            asked = new
            new, ids, sizes = self._learnt(new)
            found[found < 0] = len(self.known) + pc.index_in(asked, value_set=new).to_numpy()
            starts = len(self.ids) + np.cumsum(sizes) - sizes
            view = tuple(map(np.concatenate, zip(view, (ids, starts, sizes), strict=True)))
            if len(self.known) + len(new) <= MEMO_PIECES:
                self.known = pa.concat_arrays([self.known, new])
                self.ids, self.starts, self.sizes = view
        return found, view

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """(number of words per text, place of each word's core, of its marks, what is there)."""
        words = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = words.flatten()
        coded = flat.dictionary_encode()
        word = coded.indices.to_numpy().astype(np.int64)
        distinct = coded.dictionary
        core = pc.utf8_rtrim(distinct, _MARKS)
        plain = pc.match_substring_regex(core, _LETTERS)
        length = pc.subtract(pc.binary_length(distinct), pc.binary_length(core))
        core = pc.if_else(plain, core, distinct)
        # The first word of a text has no space before it.
        first = np.zeros(len(flat), bool)
        first[np.cumsum(counts) - counts] = True
        starters, where = np.unique(word[first], return_inverse=True)
        spaced = pc.binary_join_element_wise(_SPACE, core, _NOTHING)
        cores = pa.concat_arrays([spaced, core.take(pa.array(starters))])
        tails = length.to_numpy(zero_copy_only=False) * plain.to_numpy(zero_copy_only=False)
        suffix = pc.if_else(
            pa.array(tails > 0),
            pc.replace_substring_regex(distinct, "^[A-Za-zÀ-ÖØ-öø-ÿ]+", ""),
            _NOTHING,
        )
        everything = pa.concat_arrays([cores, suffix]).dictionary_encode()
        place, view = self._looked_up(everything.dictionary)
        place = place[everything.indices.to_numpy()]
        of_core = place[: len(distinct)][word]
        of_core[first] = place[len(distinct) : len(cores)][where]
        return counts, of_core, place[len(cores) :][word], view

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text).

        Null counts as empty.
        """
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        slow = pc.match_substring_regex(texts, _UNSAFE)
        counts, core, marks, (known, starts, lengths) = self._pieces(pc.if_else(slow, "", texts))
        both = np.empty(2 * len(core), np.int64)
        both[0::2], both[1::2] = core, marks
        sizes = lengths[both]
        ids = known[_ragged(starts[both], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], 2 * np.cumsum(counts)])]
        per_text = np.diff(ends)
        odd = np.flatnonzero(slow.to_numpy(zero_copy_only=False))
        if not len(odd):
            return ids, per_text
        rows = np.split(ids, ends[1:-1])
        for i in odd:
            rows[i], _ = self._encoded(list(safe_parts(texts[i].as_py())))
        return np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text; the ids themselves are not put together."""
        if len(texts) == 0:
            return np.zeros(0, np.int64)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        slow = pc.match_substring_regex(texts, _UNSAFE)
        counts, core, marks, (_, _, lengths) = self._pieces(pc.if_else(slow, "", texts))
        sizes = lengths[core] + lengths[marks]
        total = np.add.reduceat(sizes, np.cumsum(counts) - counts)
        for i in np.flatnonzero(slow.to_numpy(zero_copy_only=False)):
            total[i] = len(self._encoded(list(safe_parts(texts[i].as_py())))[0])
        return total


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per worker, so that what it has learnt serves later tasks too."""
    return Encoder(path)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def hand_back() -> None:
    """Give back what a batch needed: a worker serves many tasks, beside the JVM's own memory."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def byte_batches(
    batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES
) -> Iterator[pa.Table]:
    """Regroup rows into tables of about ``most`` bytes of text; a longer text is alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = int(np.searchsorted(ends, before + most - size, "right"))
            if stop == start and not held:
                stop += 1
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - before
                start = stop
            if start < batch.num_rows or size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                hand_back()
    if held:
        yield pa.Table.from_batches(held)
    held = []
    hand_back()
