"""Exact and near duplicates and repeated passages, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from postroom.llm import components, exact, passages, simhash
from postroom.llm.common import kept_rows
from tests.llm.conftest import AWKWARD, DOCS


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


@pytest.mark.parametrize("keep, share", [("largest", 10_000), ("largest", 2), ("smallest", 10_000)])
def test_exact(awkward, keep, share):
    groups = defaultdict(list)
    for r in AWKWARD:
        groups[lowered(r[1])].append(r[0])
    want = []
    for text, ids in groups.items():
        real = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(real) if real else None
        want += [(i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    got = exact.exact_duplicates(awkward, keep, share)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_exact_of_nothing(empty):
    assert exact.exact_duplicates(empty).collect() == []


def test_exact_runs_without_python(small):
    plan = exact.exact_duplicates(small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def fingerprint(text, words):
    found = re.findall(rb"[^\x20\x09-\x0D]+", lowered(text).encode())
    runs = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([b" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(bits, radius):
    """The component of each fingerprint, over all pairs."""
    bits = sorted(bits)
    root = {b: b for b in bits}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(bits):
        for b in bits[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {b: find(b) for b in bits}


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2])
def test_near(awkward, small, bucket):
    for docs in (awkward, small):
        rows = [(r.doc_id, fingerprint(r.text, 4)) for r in docs.select("doc_id", "text").collect()]
        root = joined({b for _, b in rows}, 4)
        least = defaultdict(lambda: None)
        for i, b in rows:
            if i is not None and (least[root[b]] is None or i < least[root[b]]):
                least[root[b]] = i
        got = simhash.near_duplicates(docs, bucket=bucket).collect()
        assert sorted(map(tuple, got), key=str) == sorted(((i, f"{b:016x}", least[root[b]]) for i, b in rows), key=str)


def test_near_of_nothing(empty):
    assert simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 4, 12])
def test_counters_and_buckets_miss_no_link(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(80)]
    bits = np.unique(rng.choice(base, 80) ^ np.array(flips, np.uint64))
    planes = np.ascontiguousarray(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T)
    i, j = np.triu_indices(len(bits), 1)
    near = np.bitwise_count(bits[i] ^ bits[j]) <= radius
    assert (simhash.within_radius(planes, i, j, radius) == near).all()
    masks = np.array(simhash.band_pairs(radius), np.uint64)
    assert (((bits[i] ^ bits[j])[:, None] & masks) == 0).any(axis=1)[near].all()


def test_large_groups_give_one_link_per_fingerprint_at_most():
    bits = np.arange(1 << 10, dtype=np.uint64)
    links = [pair for a, b in simhash.links_in(np.zeros(len(bits), np.int64), bits, 4) for pair in zip(a, b, strict=True)]
    assert len(links) == len(bits) - 1


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(links + links[:5], "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {x: find(x) for x in list(root)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3])
def test_near_stage_keeps_one_of_each_component(spark, small, monkeypatch, bucket):
    """Against all pairs: families of variants, chains of links, a repeated line, and texts apart."""
    rng = random.Random(3)
    texts = []
    for _ in range(20):
        base = words(rng, rng.randint(100, 400))
        for changed in (0, 1, 2, 6):
            text = list(base)
            for place in rng.sample(range(len(text)), changed):
                text[place] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(text))
        texts.append(" ".join(base[: len(base) // 2] + words(rng, len(base) // 2)))
    line = " ".join(words(rng, 15))
    texts += ["\n".join([*[line] * 40, " ".join(words(rng, 34))]) for _ in range(6)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    for docs in (spark.createDataFrame(rows, DOCS).repartition(3), small):
        bits = {r.doc_id: fingerprint(r.text, 4) for r in docs.collect()}
        root = joined(set(bits.values()), 4)
        least = {}
        for i in sorted(bits, reverse=True):
            least[root[bits[i]]] = i
        monkeypatch.setattr(simhash.kept_of_near, "__defaults__", (4, 4, bucket))
        kept = corpus_pipeline.near_stage(spark, docs, "")
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
        assert len(least) < len(bits)


def test_kept_rows_once_each(spark, awkward):
    kept = corpus_pipeline.exact_stage(spark, awkward, "")
    assert kept.columns == awkward.columns
    best = {}
    for r in AWKWARD:
        key = lowered(r[1])
        best[key] = max(best.get(key, -1), -1 if r[0] is None else r[0])
    got = [(lowered(r.text), -1 if r.doc_id is None else r.doc_id) for r in kept.collect()]
    assert sorted(got) == sorted(best.items())
    near = corpus_pipeline.near_stage(spark, awkward, "")
    assert near.columns == awkward.columns
    root = joined({fingerprint(r[1], 4) for r in AWKWARD}, 4)
    least = {}
    for r in AWKWARD:
        group = root[fingerprint(r[1], 4)]
        least[group] = min(least.get(group, (True, 0)), (r[0] is None, r[0] or 0))
    got = near.collect()
    assert len({(r.doc_id, r.text) for r in got}) == len(got)
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in got)) == sorted(least.values())
    decided = awkward.select("doc_id", F.lit("v").alias("version"), F.lit(True).alias("kept")).limit(0)
    assert kept_rows(awkward, F.lit("v"), decided).count() == awkward.count()


def removed(rows):
    """By brute force: (id, bytes, removed, spans, hash) in document order."""
    seen, out = set(), []
    for i, text in rows:
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - 99):
            if text[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(text[p : p + 100])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        out.append((i, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def digest(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_passages(spark, small, empty):
    rows = [(r.doc_id, (r.text or "").encode()) for r in small.orderBy("doc_id").collect()]
    assert digest(passages.removed_passages(small)) == sorted(removed(rows), key=str)
    assert passages.removed_passages(empty).collect() == []
    rng = random.Random(1)
    pieces = ["".join(rng.choice("ab ") for _ in range(rng.randint(60, 160))) for _ in range(12)]
    made = [(i, "".join(rng.choices(pieces, k=rng.randint(0, 6)))) for i in range(60)]
    made += [(60, "ab" * 500), (61, "ä" * 120), (62, None)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in made], DOCS)
    assert digest(passages.removed_passages(docs)) == sorted(removed([(i, (t or "").encode()) for i, t in made]), key=str)


@pytest.mark.parametrize("limits", [(1, 1 << 30, 1 << 18), (1, 1, 1 << 18), (1 << 30, 1 << 30, 7)])
def test_passages_of_anchors_that_are_keyed_in_parts(spark, limits):
    rng = random.Random(3)

    def some(n):
        return "".join(rng.choices("abcdefg ", k=n))

    lines, ends = [some(n) for n in (24, 45, 80, 99)], [some(n) for n in (12, 40, 75, 90)]
    made = [(0, some(400)), (1, "ab" * 300), (2, None)]
    for i in range(3, 120):
        made.append((i, "".join([some(rng.randint(0, 120)), rng.choice(ends), rng.choice(lines), rng.choice(ends), some(30)])))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in made], DOCS).repartition(5)
    whole = sorted(removed([(i, (t or "").encode()) for i, t in made]), key=str)
    assert sum(r[2] > 0 for r in whole) > 40
    assert digest(passages.removed_passages(docs, *limits)) == whole


def test_runs_longer_than_the_bound_come_in_pieces():
    rng = random.Random(8)
    for _ in range(200):
        keys = sorted(rng.choices(range(4), k=rng.randint(1, 40)))
        at, batches = 0, []
        while at < len(keys):
            n = rng.randint(1, 6)
            batches.append(pa.RecordBatch.from_arrays([pa.array(keys[at : at + n])], names=["key"]))
            at += n
        got, long = [], defaultdict(set)
        for table, piece in passages._bounded_runs(iter(batches), 5):
            got += table.column("key").to_pylist()
            assert not piece or len(set(table.column("key").to_pylist())) == 1
            for key in set(table.column("key").to_pylist()):
                long[key].add(piece)
                assert piece or table.column("key").to_pylist().count(key) == keys.count(key)
        assert got == keys and all(len(v) == 1 for v in long.values())


def test_passages_of_the_awkward_table(awkward):
    rows = sorted(((r[0], (r[1] or "").encode()) for r in AWKWARD), key=lambda r: (r[0] is not None, r[0] or 0))
    assert digest(passages.removed_passages(awkward)) == sorted(removed(rows), key=str)


def test_passages_of_awkward_rows(spark):
    text = "".join(random.Random(2).choices("abcdefgh ", k=400))
    rows = [(None, text), (4, text), (4, text), (4, None), (5, "x" + text[:150]), (6, "")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = {}
    for r in passages.removed_passages(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans))
    assert got[None] == [(400, 0, 0)]
    assert sorted(got[4]) == [(0, 0, 0), (400, 400, 1), (400, 400, 1)]
    assert got[5] == [(151, 150, 1)] and got[6] == [(0, 0, 0)]
    same = spark.createDataFrame([(7, text, None, None, None)] * 2, DOCS)
    assert sorted(r.n_removed for r in passages.removed_passages(same).collect()) == [0, 400]


def test_collection_is_the_sorted_suffixes():
    rng = random.Random(4)
    for _ in range(60):
        strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 10))]
        transform, common, owner, length = passages.collection(strings)
        rows = sorted((s[len(s) - j :], i, j) for i, s in enumerate(strings) for j in range(len(s) + 1))
        got = [strings[i][len(strings[i]) - j :] for i, j in zip(owner, length, strict=True)]
        assert got == [r[0] for r in rows]
        for r in range(1, len(got)):
            m = 0
            while m < min(len(got[r]), len(got[r - 1])) and got[r][m] == got[r - 1][m]:
                m += 1
            assert common[r] == m
        for i, j, symbol in zip(owner, length, transform, strict=True):
            assert symbol == (0 if j == len(strings[i]) else strings[i][len(strings[i]) - j - 1] + 1)


def test_contexts_cover_every_string_once():
    rng = np.random.default_rng(0)
    texts = ["".join(map(chr, rng.integers(97, 101, n))) for n in (0, 99, 100, 101, 777, 5_000)]
    buffer, bounds = passages.buffer_of(pa.array(texts))
    covered = defaultdict(list)
    for _, _, text, start, strings in passages.contexts(buffer, bounds):
        for t, s, n in zip(text.tolist(), start.tolist(), strings.tolist(), strict=True):
            assert 1 <= n <= 77
            covered[t] += range(s, s + n)
    assert {t: sorted(c) for t, c in covered.items()} == {
        t: list(range(len(x) - 99)) for t, x in enumerate(texts) if len(x) >= 100
    }
