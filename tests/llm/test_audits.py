"""Nearest vectors, source divergence and filter interactions, against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postroom.llm import divergence, filters, nearest
from tests.llm.conftest import AWKWARD


# Nearest vectors.


def best_rows(rows, k, asks):
    """(query_id, rank, vec_id, score) over all pairs, in plain numbers."""
    whole = [
        (i, [math.floor(64 * x) for x in v])
        for i, v, *_ in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = []
    for q, a in whole:
        if asks(q):
            scores = sorted((-sum(map(int.__mul__, a, b)), c) for c, b in whole if c != q and len(a) == len(b))
            found += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(found)


def vectors(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, score string, cell string"
    )


@pytest.mark.parametrize("shard", [nearest.LEAST_SHARD, 40])
def test_nearest(spark, monkeypatch, shard):
    monkeypatch.setattr(nearest, "LEAST_SHARD", shard)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 40))
    rows = [(i, (centres[i % 5] + rng.normal(size=40) * rng.choice([0.05, 1])).tolist()) for i in range(300)]
    # A vector that many rows share, repeated rows, and a query among them.
    rows += [(i, rows[7][1]) for i in range(300, 380)] + [rows[20], rows[20], rows[9], rows[9], rows[9]]
    got = nearest.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=6)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == best_rows(rows, 6, lambda i: i % 20 == 0)


@pytest.mark.parametrize("sparse", [0.0, 0.3, 2.0])
@pytest.mark.parametrize("size", [12.0, 1e4, 1e9])
def test_compaction_by_columns_and_by_pairs(monkeypatch, sparse, size):
    monkeypatch.setattr(nearest, "SPARSE", sparse)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(3, 50))
    near = np.floor(size * (centres[np.arange(600) % 3] + rng.normal(size=(600, 50)) * rng.choice([0.1, 1], (600, 1))))
    tile = nearest.Tile(np.arange(20), near[:20], 4)
    for at in range(0, 600, 150):
        tile.meet(np.arange(at, at + 150), np.ascontiguousarray(near[at : at + 150].T))
    exact = [[int(x) for x in row] for row in near.tolist()]
    got = sorted(zip(*(x.tolist() for x in tile.best()), strict=True))
    want = []
    for q in range(20):
        scores = sorted((-sum(map(int.__mul__, exact[q], b)), c) for c, b in enumerate(exact) if c != q)
        want += [(q, c, max(min(-s, 2**63 - 1), 1 - 2**63)) for s, c in scores[:4]]
    if size < 1e9:
        assert got == sorted(want)
    else:
        assert sorted(s for *_, s in got) == sorted(s for *_, s in want)


def test_bounds_spare_work_and_lose_nothing():
    """Once scores are there, short vectors are left after the first dimensions, long ones read to the end."""
    rng = np.random.default_rng(2)
    queries = np.round(rng.normal(size=(8, 64)) * 20)
    lengths = np.where(np.arange(500) < 254, 20, np.where(np.arange(500) % 50 == 0, 40, 1))
    columns = np.round(rng.normal(size=(64, 500)) * lengths)
    tile = nearest.Tile(np.arange(8), queries, 3)
    alive, pairs = [], tile._pairs

    def counting(*given):
        alive.append(len(given[5]))
        pairs(*given)

    tile._pairs = counting
    for at in (0, 254):
        tile.meet(np.arange(100 + at, 100 + min(500, at + 254)), columns[:, at : at + 254])
    scores = queries @ columns
    for row, found, score in zip(*tile.best(), strict=True):
        assert score == scores[row, found - 100] and (scores[row] > score).sum() < 3
    assert len(alive) == 1 and 0 < alive[0] <= 8 * 5


def test_nearest_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (20, [nan, 1.0]), (40, None), (60, [None, 1.0]), (80, [inf, 0.0]), (None, [1.0, 1.0]),
        (1, [-0.01, 0.5]), (2, [-0.01, 0.5]), (100, []), (101, []), (120, [1.0, 2.0, 3.0]), (140, [3e5, -2e6]),
        (141, [1e12, 1e12]), (160, [-1e9, 2.5]),
    ]
    got = nearest.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=3)
    assert sorted(map(tuple, got.collect())) == best_rows(rows, 3, lambda i: i % 20 == 0)


def test_nearest_of_nothing(spark):
    assert nearest.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert nearest.nearest(vectors(spark, [(1, [1.0])]), F.col("vec_id") % 20 == 0).collect() == []


# Source divergence.


def divergences(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")) for text, lang, source in rows]
    docs = [(a, b, [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in ws]) for a, b, ws in docs]
    holders, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        holders[lang].update(set(words))
        counts[lang, source].update(words)
    found = []
    for lang in {a for a, _, _ in docs}:
        kept = sorted(w for w, n in holders[lang].items() if n >= least)

        def prices(count, kept=kept):
            total = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 5) // (total + 5 * len(kept)) for w in kept}

        sources = sorted({b for a, b, _ in docs if a == lang})
        p = {s: prices(counts[lang, s]) for s in sources}
        q = prices(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in sources if o != s]
            terms = [(q[w] - p[s][w], w.encode()) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                found += [(lang, s, part, item.decode(), -v, r + 1) for r, (v, item) in enumerate(ranked)]
    return sorted(found)


def made_up(seed, sources, rows):
    """Texts whose words depend on their source, in two languages."""
    rng = random.Random(seed)
    words = [a + b + c for a in "bdglé" for b in "aouI" for c in ("n", "rst", "ß", "")]
    out = []
    for i in range(rows):
        source = rng.randrange(sources)
        size = rng.choice([0, 3, 40])
        text = rng.choice(" ,.1\n@").join(words[int(rng.random() ** (1 + source % 4) * len(words))] for _ in range(size))
        out.append((i, text, rng.choice(["en", "de", None]), rng.choice([f"s{source}", f"s{source}", None]), 0))
    return out


@pytest.mark.parametrize("sources, columns, tile", [(7, divergence.COLUMNS, divergence.ROWS), (40, 16, 16)])
def test_divergence(spark, sources, columns, tile):
    rows = made_up(sources, sources, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = divergence.source_divergence(docs, documents=4, top=5, columns=columns, rows=tile)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergences([r[1:4] for r in rows], 4, 5)


def test_divergence_of_awkward_rows(awkward, empty):
    for least in (1, 2, 100):
        got = divergence.source_divergence(awkward, documents=least, top=50)
        assert sorted(map(tuple, got.collect())) == divergences([r[1:4] for r in AWKWARD], least, 50)
    assert divergence.source_divergence(empty).collect() == []


@pytest.mark.parametrize("seed, rows, columns", [(1, 5, 3), (2, 16, 64), (3, 20, 200), (4, 1, 1), (5, 9, 0)])
def test_trees(seed, rows, columns):
    rng = np.random.default_rng(seed)
    least = np.zeros(-(-rows // 8) * 8, np.int64)
    least[:rows] = rng.integers(1, 100, rows)
    dense = np.repeat(least[:rows, None], columns, axis=1)
    row, column = np.nonzero(rng.random((rows, columns)) < 0.05)
    dense[row, column] = value = rng.integers(100, 200, len(row))
    depth = max(0, int(np.ceil(np.log2(max(rows, columns, 1) / 8))))
    tree = divergence.Tree(row, column, value, least, depth)
    apart, empty = divergence.differences(tree, tree, depth, (rows, rows), columns)
    apart += empty * np.abs(least[:, None] - least)
    i, j = np.triu_indices(rows, 1)
    assert (apart[i, j] == np.abs(dense[i] - dense[j]).sum(axis=1)).all()
    if columns == 200:
        assert empty.max() > 0


def test_terms_of_long_texts_are_not_cut(monkeypatch):
    monkeypatch.setattr(divergence, "RUN_BYTES", 5)
    text = "Ein éLANGES wort, und-noch 1 eins" + "x" * 50 + " ."
    assert [w for run in divergence.word_runs(text.encode()) for w in run] == [
        w.encode() for w in ["ein", "élanges", "wort", "und", "noch", "eins" + "x" * 50]
    ]


# Filter interactions.


def failing(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        f
        for f, fails in {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
        }.items()
        if fails
    }


def interactions(rows, labels):
    good = {i for i, quality, _ in labels if i is not None and quality == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = [
        (i, lang or "", failing(text or "") | ({"E"} if i is not None and least[text or ""] < i else set()))
        for i, text, lang in rows
    ]
    found = []
    for part in {lang for _, lang, _ in docs}:
        mine = [(i, f) for i, lang, f in docs if lang == part]
        orders = list(itertools.permutations("ABCDE"))
        shapley = Counter(next((x for x in o if x in f), None) for o in orders for _, f in mine)
        for order in orders:
            left = mine
            for step, x in enumerate(order):
                removed = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                fails = sum(x in f for _, f in mine)
                found.append((
                    part, "".join(order), step + 1, len(left), len(removed), fails - len(removed),
                    sum(f == {x} for _, f in mine), sum(i in good for i, _ in removed),
                    sum(i in toxic for i, _ in removed), shapley[x],
                ))
    return sorted(found)


def test_filters(spark, small, labels, awkward):
    marks = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    marks += [(None, 1, 1), (4, None, None), (4, 1, None), (4, 0, 1), (999_999, 1, 1)]
    given = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for docs, trie in ((small, filters.TRIE_BYTES), (awkward, filters.TRIE_BYTES), (small, 10_000)):
        rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
        got = filters.filter_interactions(docs, given, trie_bytes=trie)
        assert sorted(map(tuple, got.collect())) == interactions(rows, marks)


def test_filters_of_nothing(empty, no_labels, small):
    assert filters.filter_interactions(empty, no_labels).collect() == []
    assert len(filters.filter_interactions(small, no_labels).collect()) == 600 * small.select("lang").distinct().count()


def test_copies_over_many_batches(spark):
    """A third of all rows is one text; every batch settles all of its copies but one."""
    rng = random.Random(3)
    shared = "one beginning that all texts share, " * 30
    texts = [shared + rng.choice(["same", str(i % 70)]) for i in range(600)]
    rows = [(rng.randrange(400), t, rng.choice(["en", "de"])) for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    got = Counter()
    for r in filters.failure_masks(docs, trie_bytes=20_000, batch_bytes=20_000).collect():
        got[r.doc_id, r.lang, bool(r["mask"] & filters.REPEATED)] += r.copies
    least = {t: min(i for i, u, _ in rows if u == t) for t in set(texts)}
    assert got == Counter((i, lang, least[t] < i) for i, t, lang in rows)


def test_trie():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(300)]
    trie = filters.Trie()
    for i, text in enumerate(texts):
        trie.insert(text, (i * 37) % 300, (i,))
    least = {t: min((i * 37) % 300 for i, u in enumerate(texts) if u == t) for t in texts}
    assert sorted(trie.repeated(), key=lambda r: r[1]) == [
        (least[t] < (i * 37) % 300, (i,)) for i, t in enumerate(texts)
    ]


def test_prefixes_part_evenly_what_begins_alike():
    texts = [b"the very same beginning %05d" % i for i in range(1_000)] + [b"", b"z"]
    prefixes = filters.adaptive_prefixes(texts, 8)
    assert len(prefixes) == 7 and max(map(len, prefixes)) <= len(texts[0])
    shares = Counter(sum(p <= t for p in prefixes) for t in texts)
    assert max(shares.values()) < 2 * len(texts) / 8
    assert filters.adaptive_prefixes([], 8) == filters.adaptive_prefixes([b"a"], 8) == []


def test_words_of_long_texts(monkeypatch):
    monkeypatch.setattr(filters, "RUN_BYTES", 7)
    text = b"a bb  ccc\x0bdddd\x1ceeee eeee \xc2\xa0 " * 9 + b"longer" * 10
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    assert filters.word_counts(text) == (len(words), len(set(words)))
