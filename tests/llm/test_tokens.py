"""Token counts, token files and packing, against the library itself."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postroom.llm import encoding, packing, token_files, tokens
from postroom.llm.common import fresh_path, written
from tests.llm.conftest import AWKWARD

PATH = encoding.vocabulary("byte_bpe_50k.json")


def library(text):
    return encoding.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


TEXTS = ["", " ", "  a", "a  b", "a \n b", "don't. a,b (c)", " lead", "trail ", "\n\n a", "x " * 40_000,
         "it's <|endoftext|> x<|endoftext|>", "é é.  x", "ab'll. 'x'", "a\tb  c", *(r[1] for r in AWKWARD)]


def test_ids_are_those_of_the_library():
    ids, counts = encoding.Encoder(PATH).encode(pa.array(TEXTS, pa.string()))
    assert [list(map(int, r)) for r in np.split(ids, np.cumsum(counts)[:-1])] == [library(t) for t in TEXTS]
    assert encoding.Encoder(PATH).lengths(pa.array(TEXTS, pa.string())).tolist() == counts.tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \t\nabzÉß'.,!　 1½中'", max_size=30), max_size=6))
def test_ids_of_any_text(texts):
    ids, counts = encoding.encoder(PATH).encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for t in texts for i in library(t)]
    assert counts.tolist() == [len(library(t)) for t in texts]


def test_a_full_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(encoding, "MEMO_PIECES", 3)
    coder = encoding.Encoder(PATH)
    for _ in range(2):
        ids, _ = coder.encode(pa.array(TEXTS, pa.string()))
        assert ids.tolist() == [i for t in TEXTS for i in library(t)]


def test_parts_are_cut_before_white_space():
    text = "ab  cd\n" * 50
    assert "".join(encoding.safe_parts(text, 10)) == text
    assert sum(len(library(p)) for p in encoding.safe_parts(text, 10)) == len(library(text))
    assert list(encoding.safe_parts("x" * 99, 10)) == ["x" * 99]


def test_batches_hold_every_row_once_and_few_bytes():
    rows = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 30, 7, 7, 7, 1)])], names=["text"])
    tables = list(encoding.byte_batches(iter([rows, rows]), "text", 14))
    assert [t for table in tables for t in table.column("text").to_pylist()] == 2 * rows.column(0).to_pylist()
    assert all(table.num_rows == 1 or sum(map(len, table.column(0).to_pylist())) <= 14 for table in tables)


def test_counts(awkward, empty):
    got = sorted(map(tuple, tokens.token_counts(awkward, PATH, limit=6).collect()), key=str)
    want = [(r[0], len((r[1] or "").encode()), len(library(r[1])), len(library(r[1])) > 6) for r in AWKWARD]
    assert got == sorted(want, key=str)
    assert tokens.token_counts(empty, PATH).collect() == []


def test_token_files_round_trip(spark, awkward, empty):
    got = token_files.token_files(awkward, PATH).collect()
    want = [(r[0], [*library(r[1]), 2]) for r in AWKWARD]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(
        ((i, len(ids), crc(ids)) for i, ids in want), key=str
    )
    rows = sorted(got, key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    assert [-1 if r.doc_id is None else r.doc_id for r in rows] == sorted(-1 if r[0] is None else r[0] for r in AWKWARD)
    assert token_files.token_files(empty, PATH).collect() == []


def test_readers_take_single_documents_and_notice_damage(spark, small, tmp_path):
    files = token_files.write_token_files(small, PATH, f"file://{tmp_path}/tokens")
    texts = {r.doc_id: r.text for r in small.collect()}
    found = {}
    for uri, _ in files:
        found.update((i, ids.tolist()) for i, ids in token_files.TokenFile.open(uri).documents({3, 77, 150}))
    assert found == {i: [*library(texts[i]), 2] for i in (3, 77, 150)}
    path = files[0][0].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[12] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception):
        list(token_files.TokenFile.open(files[0][0]).read())


def filled(placements):
    sequences = defaultdict(list)
    for p in placements:
        for i in range(p.count):
            sequences[p.first + i // p.per_sequence].append((p.offset + i % p.per_sequence * p.length, p.length))
    return sequences


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plans_place_every_piece_without_gaps(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    placements, number = packing.plan(histogram, 40)
    sequences = filled(placements)
    assert len(sequences) == number
    assert sorted(n for pieces in sequences.values() for _, n in pieces) == sorted(lengths)
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 40


def fewest(lengths, capacity):
    """The least number of sequences, by trying everything."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_what_the_reduction_fixes_loses_nothing(lengths):
    lengths = sorted(lengths, reverse=True)
    reduced = packing._Plan({n: lengths.count(n) for n in set(lengths)}, 20)
    reduced.reduce()
    left = [n for n in range(20, 0, -1) for _ in range(int(reduced.left[n]))]
    assert reduced.sequences + (fewest(left, 20) if left else 0) == fewest(lengths, 20)


def test_parts_grow_with_the_count_and_stay_bounded():
    assert packing.parts_of({}) == {}
    assert packing.parts_of({1: 1, 2: 4_096, 3: 4_097}) == {1: 1, 2: 1, 3: 2}
    many = packing.parts_of({n: 10**9 for n in range(1, 1024)})
    assert sum(many.values()) <= packing.MOST_PARTS + 1024


@pytest.mark.parametrize("rows", [packing.PART_ROWS, 2])
def test_packing(awkward, empty, small, rows):
    part_rows = rows
    for docs in (awkward, small):
        texts = defaultdict(list)
        for r in docs.select("doc_id", "text").collect():
            texts[r.doc_id].append(np.array([*library(r.text), 2], "<u4"))
        rows = packing.pack_pieces(written(packing.pieces_of(docs, PATH), "pieces"), rows=part_rows).collect()
        sequences = defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append((r.offset, r.length))
            assert any(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in texts[r.doc_id])
            assert r.piece == 0 or r.length == 1024
        assert sum(r.length for r in rows) == sum(len(i) for t in texts.values() for i in t)
        assert len(rows) == sum(-(-len(i) // 1024) for t in texts.values() for i in t)
        for pieces in sequences.values():
            ends = [0, *(o + n for o, n in sorted(pieces))]
            assert ends[:-1] == [o for o, _ in sorted(pieces)] and ends[-1] <= 1024
    assert packing.packed(empty, PATH).collect() == []
