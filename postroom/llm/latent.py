"""Benchmark decontamination by latent semantic retrieval.

Words weigh by their inverse frequency in all documents. The benchmark's passages
are the rows of a TF-IDF matrix whose right singular vectors a distributed
randomised SVD finds; they span the latent space. Every passage of every document
is projected into it, and an item whose cosine is high is a candidate. So is an item
that a passage shares a run of words with, however common a leak has made them. A candidate
counts once its words, in order, make up enough of the item: by longest common
subsequence over the item, or over somewhat less of it when its answer, its last
sentence, is there too; an item too few of whose words are there in any order cannot,
and is not compared. So copies are found and paraphrases that keep most words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import buffer_of, partitions, small_batches, text_of
from postroom.llm.encoding import byte_batches

BITS = 16
BUCKETS = 1 << BITS
# Words of a passage and from one passage to the next.
PASSAGE, STEP = 32, 16
# A longer item is asked for by passages of its own.
ITEM = 64
RANK, EXTRA, SEED = 240, 16, 42
# A word more frequent than one in so many carries no weight in retrieval.
COMMON_WORD = 1_000
# Least cosine of a passage and a query. A passage whose words of the benchmark hold
# less than its square of the passage's weight cannot reach it.
COSINE = 0.35
# Of an item the space holds less of than this, the TF-IDF cosine itself is taken too.
HELD = 0.95
# Words of passages times items with that word that are added up at a time.
PRODUCTS = 1 << 21
# Least shares of an item in the longest common subsequence: alone, or with so much of the answer.
COMMON, COMMON_WITH_ANSWER, ANSWER = 0.7, 0.6, 0.8
# A passage that has so many words of an item in a row, or a whole shorter item, is compared with it.
RUN = 4
# Query passages that are searched for in one pass over the documents, and passages
# of documents that are projected and compared at a time.
QUERIES, PROJECTED = 20_000, 512
# Text taken apart at a time: some 52 bytes of memory each.
RUN_BYTES = 1024 * 1024


def _fold_table() -> np.ndarray:
    """Letters, digits and bytes of longer characters stand, lower-cased; all else parts words."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        if chr(b).isascii() and chr(b).isalnum():
            table[b] = ord(chr(b).lower())
        elif b >= 128:
            table[b] = b
    return table


_FOLD = _fold_table()
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))


def words_of(buffer: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of every word, bounds of texts among words, does a sentence end after it)."""
    folded = _FOLD[buffer]
    # Accented capitals of the Latin-1 letters follow the byte C3.
    after = np.concatenate([[False], buffer[:-1] == 0xC3])
    capital = after & (buffer >= 0x80) & (buffer <= 0x9E) & (buffer != 0x97)
    folded[capital] += 0x20
    inside = folded > 0
    edge = np.zeros(len(buffer) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], inside[:-1]])
    first = np.flatnonzero(inside & (edge[:-1] | ~before))
    behind = np.concatenate([inside[1:], [False]])
    last = np.flatnonzero(inside & (edge[1:] | ~behind))
    place = np.arange(len(buffer), dtype=np.int64)
    place -= _since(first, len(buffer))
    # A byte counts by its value and its place in the word.
    mixed = (folded.astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    sums = np.zeros(len(mixed) + 1, np.uint64)
    np.cumsum(mixed, out=sums[1:])
    hashes = sums[last + 1] - sums[first]
    stopped = np.concatenate([[0], np.cumsum(_STOP[buffer])])
    upto = np.append(first[1:], len(buffer))
    ends = stopped[upto] > stopped[last + 1]
    return hashes, np.searchsorted(first, bounds), ends


def _since(first: np.ndarray, size: int) -> np.ndarray:
    """Start of the latest word at or before each byte; 0 before any."""
    start = np.zeros(size, np.int64)
    start[first] = first
    return np.maximum.accumulate(start)


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for rows in byte_batches(batches, "text", RUN_BYTES):
        hashes, _, _ = words_of(*buffer_of(rows.column("text")))
        counts += np.bincount(buckets_of(hashes), minlength=BUCKETS)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["bucket", "n"])


def word_weights(docs: DataFrame) -> np.ndarray:
    """Inverse frequency of every word bucket over all of ``docs(text, ...)``.

    On a logarithmic scale that begins at words of one in ``COMMON_WORD``.
    """
    small_batches(docs.sparkSession)
    found = (
        docs.select(text_of().alias("text"))
        .mapInArrow(_counting, "bucket long, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    counts = np.zeros(BUCKETS)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    inverse = np.log((counts.sum() + COMMON_WORD) / (counts + 1))
    return np.maximum(inverse - np.log(COMMON_WORD), 0).astype(np.float32)


@dataclass(frozen=True)
class Item:
    """An item's words, and those of its answer."""

    item_id: int
    hashes: np.ndarray
    answer: np.ndarray

    def queries(self) -> list[np.ndarray]:
        if len(self.hashes) <= ITEM:
            return [self.hashes] if len(self.hashes) else []
        return [self.hashes[a : a + ITEM] for a in range(0, len(self.hashes) - ITEM // 2, ITEM // 2)]


def _items(batch: pa.RecordBatch) -> Iterator[Item]:
    hashes, bounds, ends = words_of(*buffer_of(batch.column("text")))
    for item_id, a, b in zip(batch.column("item_id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
        before = np.flatnonzero(ends[a : max(a, b - 1)])
        yield Item(item_id, hashes[a:b], hashes[a + (before[-1] + 1 if len(before) else 0) : b])


def _rows(items: Iterator[Item], weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each query passage's unit TF-IDF vector."""
    for item in items:
        for query in item.queries():
            buckets, counts = np.unique(buckets_of(query), return_counts=True)
            values = counts * weights[buckets]
            yield buckets, values / max(np.linalg.norm(values), 1e-9)


def _random_rows(buckets: np.ndarray, columns: int) -> np.ndarray:
    """Rows of one Gaussian matrix, the same in every task."""
    return np.stack([np.random.default_rng((SEED, int(b))).standard_normal(columns) for b in buckets])


def _sketching(weights: np.ndarray, columns: int) -> Callable:
    """Add up A'(A G) over a task's rows of A."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        random: dict[int, np.ndarray] = {}
        for batch in batches:
            for buckets, values in _rows(_items(batch), weights):
                new = [b for b in buckets.tolist() if b not in random]
                if new:
                    random.update(zip(new, _random_rows(np.array(new), columns), strict=True))
                row = values @ np.stack([random[b] for b in buckets.tolist()])
                for b, v in zip(buckets.tolist(), values.tolist(), strict=True):
                    total[b] = total.get(b, 0) + v * row
        yield from _vectors(total)

    return sketch


def _squaring(weights: np.ndarray, place: np.ndarray, basis: np.ndarray) -> Callable:
    """Add up (A Q)'(A Q) over a task's rows of A."""

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((basis.shape[1],) * 2)
        for batch in batches:
            for buckets, values in _rows(_items(batch), weights):
                row = values @ basis[place[buckets]]
                total += np.outer(row, row)
        yield from _vectors(dict(enumerate(total)))

    return square


def _vectors(rows: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(rows), pa.int64()), pa.array([np.asarray(v, "<f8").tobytes() for v in rows.values()], pa.binary())],
        names=["row", "vector"],
    )


def _adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, vector in zip(batch.column("row").to_pylist(), batch.column("vector").to_pylist(), strict=True):
            total[row] = total.get(row, 0) + np.frombuffer(vector, "<f8")
    yield from _vectors(total)


def _summed(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Add vectors of the same row where they meet, and bring the sums, which are bounded, here."""
    n = partitions(parts.sparkSession)
    rows = parts.repartition(n, "row").mapInArrow(_adding, "row long, vector binary").collect()
    rows.sort(key=lambda r: r["row"])
    return (
        np.array([r["row"] for r in rows], np.int64),
        np.array([np.frombuffer(r["vector"], "<f8") for r in rows]),
    )


def latent_space(benchmark: DataFrame, weights: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(place of each bucket in the space or -1, right singular vectors by place).

    Randomised SVD over the rows of ``benchmark(item_id, text)`` where they lie: the
    driver factorises one matrix of at most 65,536 by rank rows and a square one.
    """
    place = np.full(BUCKETS, -1, np.int64)
    schema = "row long, vector binary"
    buckets, sketch = _summed(benchmark.mapInArrow(_sketching(weights, rank + EXTRA), schema))
    if not len(buckets):
        return place, np.zeros((0, 1), np.float32)
    place[buckets] = np.arange(len(buckets))
    basis, _ = np.linalg.qr(sketch)
    _, square = _summed(benchmark.mapInArrow(_squaring(weights, place, basis), schema))
    values, turn = np.linalg.eigh(square)
    kept = np.argsort(-values)[:rank]
    kept = kept[values[kept] > 1e-9 * values.max()]
    return place, (basis @ turn[:, kept]).astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    where: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        where[word] = where.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for word in b.tolist():
        match = row & where.get(word, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def _runs_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash of the run of so many words that begins at each place."""
    count = max(0, len(hashes) - words + 1)
    mixed = np.zeros(count, np.uint64)
    for i in range(words):
        mixed = (mixed ^ hashes[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


class Runs:
    """Where texts have a run of words of a query passage."""

    def __init__(self, queries: list[np.ndarray]):
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for q, query in enumerate(queries):
            words = min(RUN, len(query))
            found = np.unique(_runs_of(query, words))
            parts.setdefault(words, []).append((found, np.full(len(found), q)))
        self.by_length = {}
        listed: list[np.ndarray] = [np.zeros(0, np.int64)]
        for words, pairs in parts.items():
            runs, owners = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.argsort(runs, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[runs >> np.uint64(44)] = True
            self.by_length[words] = runs[order], sum(map(len, listed)), seen
            listed.append(owners[order])
        self.owners = np.concatenate(listed)

    def places(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(first word, first and end of its queries in ``owners``, words) of every run found, also across texts."""
        for words, (runs, offset, seen) in self.by_length.items():
            here = _runs_of(hashes, words)
            maybe = np.flatnonzero(seen[here >> np.uint64(44)])
            low, high = np.searchsorted(runs, here[maybe], "left"), np.searchsorted(runs, here[maybe], "right")
            found = low < high
            yield maybe[found], low[found] + offset, high[found] + offset, words

    def spread(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each row with each of its run's queries, about ``PRODUCTS`` at a time."""
        ends = np.cumsum(high - low)
        parts = np.searchsorted(ends, np.arange(PRODUCTS, ends[-1] + PRODUCTS, PRODUCTS)) + 1 if len(ends) else []
        at = 0
        for stop in parts:
            times = (high - low)[at:stop]
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield np.repeat(rows[at:stop], times), self.owners[np.repeat(low[at:stop], times) + nth]
            at = stop


class Overlap:
    """How many words of an item occur in a region at all; no common subsequence is longer."""

    def __init__(self, items: list[Item]):
        self.sizes = np.array([len(item.hashes) for item in items], np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.known, self.words = np.unique(
            np.concatenate([np.zeros(0, np.uint64), *(item.hashes for item in items)]), return_inverse=True
        )

    def counts(self, numbers: np.ndarray, region: np.ndarray) -> np.ndarray:
        """For items by number, none of them without words."""
        place = np.minimum(np.searchsorted(self.known, region), len(self.known) - 1)
        present = np.zeros(len(self.known), np.int64)
        present[place[self.known[place] == region]] = 1
        sizes = self.sizes[numbers]
        first = np.cumsum(sizes) - sizes
        nth = np.arange(sizes.sum()) + np.repeat(self.start[numbers] - first, sizes)
        return np.add.reduceat(present[self.words[nth]], first)


class Exact:
    """TF-IDF cosines with some of the query passages, from the queries of each bucket."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], asked: np.ndarray):
        self.queries = len(rows)
        buckets, values = (np.concatenate([np.zeros(0), *(rows[q][i] for q in asked)]) for i in (0, 1))
        owners = np.repeat(asked, [len(rows[q][0]) for q in asked])
        weighty = np.flatnonzero(values > 0)
        order = weighty[np.argsort(buckets[weighty], kind="stable")]
        self.values, self.owners = values[order], owners[order]
        self.start = np.searchsorted(buckets[order], np.arange(BUCKETS + 1))

    def reached(
        self, row: np.ndarray, buckets: np.ndarray, weights: np.ndarray, norms: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passage, query, cosine) of ``COSINE`` or more; ``row`` is the sorted passage of each word."""
        low, times = self.start[buckets], np.diff(self.start)[buckets]
        ends = np.cumsum(times)
        begins = np.append(np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])), len(row)) if len(row) else [0]
        at = 0
        while at < len(begins) - 1:
            done = ends[begins[at] - 1] if begins[at] else 0
            last = at + 1
            while last < len(begins) - 1 and ends[begins[last + 1] - 1] - done <= PRODUCTS:
                last += 1
            part = slice(begins[at], begins[last])
            at = last
            n = times[part]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[part], n)
            key, where = np.unique(np.repeat(row[part], n) * self.queries + self.owners[nth], return_inverse=True)
            products = np.bincount(where, np.repeat(weights[part], n) * self.values[nth], minlength=len(key))
            cosines = products / norms[key // self.queries]
            high = cosines >= COSINE
            yield key[high] // self.queries, key[high] % self.queries, cosines[high]


def _searching(
    weights: np.ndarray, place: np.ndarray, space: np.ndarray, items: list[Item], common: tuple[float, float, float]
) -> Callable:
    owners = np.array([i for i, item in enumerate(items) for _ in item.queries()], np.int64)
    queries = np.zeros((len(owners), space.shape[1]), np.float32)
    rows = list(_rows(iter(items), weights))
    for i, (buckets, values) in enumerate(rows):
        known = place[buckets] >= 0
        queries[i] = values[known].astype(np.float32) @ space[place[buckets[known]]]
    held = np.linalg.norm(queries, axis=1, keepdims=True)
    queries /= np.maximum(held, 1e-9)
    exact = Exact(rows, np.flatnonzero(held[:, 0] < HELD))
    runs = Runs([query for item in items for query in item.queries()])
    overlap = Overlap(items)

    def confirmed(item: Item, region: np.ndarray) -> tuple[float, float] | None:
        share = common_subsequence(item.hashes, region) / len(item.hashes)
        answer = common_subsequence(item.answer, region) / max(1, len(item.answer))
        alone, with_answer, of_answer = common
        return (share, answer) if share >= alone or (share >= with_answer and answer >= of_answer) else None

    def found(hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, cosine, share, answer) of confirmed items."""
        buckets = buckets_of(hashes)
        weight, at = weights[buckets], place[buckets]
        count = np.diff(bounds)
        passages = np.maximum(1, -(-(count - (PASSAGE - STEP)) // STEP)) * (count > 0)
        text = np.repeat(np.arange(len(count)), passages)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(passages) - passages, passages)
        start = bounds[text] + nth * STEP
        stop = np.minimum(start + PASSAGE, bounds[text + 1])
        squares = weight.astype(np.float64) ** 2
        whole = np.concatenate([[0], np.cumsum(squares)])
        inside = np.concatenate([[0], np.cumsum(squares * (at >= 0))])
        hold, total = inside[stop] - inside[start], whole[stop] - whole[start]
        shared = _shared(hashes, bounds, count, passages)
        kept = (hold > 0) & (hold >= COSINE**2 * total)
        kept[shared[:, 0]] = True
        kept = np.flatnonzero(kept)
        # Passages to project at a time, so that memory stays bounded.
        for low in range(0, len(kept), PROJECTED):
            some = kept[low : low + PROJECTED]
            a, b = np.searchsorted(shared[:, 0], [some[0], some[-1] + 1])
            yield from _of(some, shared[a:b], text, start, stop, at, weight, hashes, bounds)

    def _shared(hashes: np.ndarray, bounds: np.ndarray, count: np.ndarray, passages: np.ndarray) -> np.ndarray:
        """Rows (passage, first and end of queries) of a run of words in common, in order and each once."""
        first = np.cumsum(passages) - passages
        found = [np.zeros((0, 3), np.int64)]
        for place, low, high, words in runs.places(hashes):
            text = np.searchsorted(bounds, place, "right") - 1
            within = place + words <= bounds[text + 1]
            place, low, high, text = place[within], low[within], high[within], text[within]
            nth = np.minimum((place - bounds[text]) // STEP, passages[text] - 1)
            found.append(np.stack([first[text] + nth, low, high], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def _possible(numbers: np.ndarray, region_of: Callable[[int], np.ndarray]) -> np.ndarray:
        """Which of the items have enough of their words near a passage, in whatever order."""
        sizes = overlap.sizes[numbers]
        enough = np.zeros(len(numbers), bool)
        # Items of like lengths share the region of the longest of them.
        kind = np.frexp(sizes)[1]
        for like in np.unique(kind):
            some = np.flatnonzero(kind == like)
            counts = overlap.counts(numbers[some], region_of(sizes[some].max()))
            enough[some] = counts / sizes[some] >= min(common[0], common[1])
        return enough

    def _of(kept, shared, text, start, stop, at, weight, hashes, bounds) -> Iterator[tuple]:
        sizes = (stop - start)[kept]
        row = np.repeat(np.arange(len(kept)), sizes)
        word = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start[kept], sizes)
        squares = np.bincount(row, weight[word] ** 2, minlength=len(kept))
        known = (at[word] >= 0) & (weight[word] > 0)
        row, word = row[known], word[known]
        vectors = np.zeros((len(kept), space.shape[1]), np.float32)
        if len(row):
            parts = space[at[word]] * weight[word][:, None]
            begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            vectors[row[begin]] = np.add.reduceat(parts, begin, axis=0)
        # By the passage's whole length: what lies outside the space counts against it.
        norms = np.sqrt(np.maximum(squares, 1e-9))
        vectors /= norms[:, None].astype(np.float32)
        cosines = vectors @ queries.T
        for passage, query, cosine in exact.reached(row, buckets_of(hashes[word]), weight[word], norms):
            cosines[passage, query] = np.maximum(cosines[passage, query], cosine)
        candidate = cosines >= COSINE
        for passage, query in runs.spread(np.searchsorted(kept, shared[:, 0]), shared[:, 1], shared[:, 2]):
            candidate[passage, query] = True
        for passage in np.flatnonzero(candidate.any(axis=1)).tolist():
            k = kept[passage]
            t = text[k]

            def region_of(reach: int) -> np.ndarray:
                return hashes[max(bounds[t], start[k] - reach) : min(bounds[t + 1], stop[k] + reach)]

            query = np.flatnonzero(candidate[passage])
            numbers, first = np.unique(owners[query], return_index=True)
            best = np.maximum.reduceat(cosines[passage, query], first)
            possible = _possible(numbers, region_of)
            for number, cosine in zip(numbers[possible].tolist(), best[possible].tolist(), strict=True):
                item = items[number]
                shares = confirmed(item, region_of(len(item.hashes)))
                if shares:
                    yield int(t), item.item_id, cosine, *shares

    def search(rows: pa.Table) -> dict[tuple[int, int], tuple[float, float, float]]:
        """By row and item, of several passages the one that holds most of the item."""
        hashes, bounds, _ = words_of(*buffer_of(rows.column("text")))
        best: dict[tuple[int, int], tuple] = {}
        for text, item_id, cosine, share, answer in found(hashes, bounds):
            ranked = (share, answer, cosine)
            if ranked > best.get((text, item_id), (-1.0,)):
                best[text, item_id] = ranked
        return best

    return search


def _listing(*prepared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searching(*prepared)
        for rows in byte_batches(batches, "text", RUN_BYTES):
            best = search(rows)
            keys = rows.column("doc_id").combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array([t for t, _ in best], pa.int64())),
                    pa.array([i for _, i in best], pa.int64()),
                    *(pa.array([r[place] for r in best.values()], pa.float64()) for place in (2, 0, 1)),
                ],
                names=["doc_id", "item_id", "cosine", "common", "answer"],
            )

    return run


def _dropping(*prepared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searching(*prepared)
        for rows in byte_batches(batches, "text", RUN_BYTES):
            clean = np.ones(rows.num_rows, bool)
            clean[[t for t, _ in search(rows)]] = False
            yield from rows.filter(pa.array(clean)).combine_chunks().to_batches()

    return run


def _passes(docs: DataFrame, benchmark: DataFrame, common: tuple[float, float, float], queries: int) -> Iterator[tuple]:
    """What a search needs, for as many passes as the benchmark takes."""
    small_batches(docs.sparkSession)
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    weights = word_weights(docs)
    place, space = latent_space(asked, weights)
    # An item has at most one passage per so many bytes, as a word takes two with what parts it from the next.
    most = F.greatest(F.ceil(F.octet_length("text") / (2 * STEP)), F.lit(1))
    passages = asked.agg(F.coalesce(F.sum(most), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, -(-passages // queries))
    for i in range(passes):
        share = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i)
        items = [item for batch in share.toArrow().to_batches() for item in _items(batch)]
        yield weights, place, space, items, common


def benchmark_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    common: tuple[float, float, float] = (COMMON, COMMON_WITH_ANSWER, ANSWER),
    queries: int = QUERIES,
) -> DataFrame:
    """(doc_id, item_id, cosine, common, answer): documents that hold a benchmark item.

    One row per row of ``docs(doc_id, text, ...)`` and item of ``benchmark(item_id, text,
    ...)`` found in it, with the latent cosine of its best passage and the shares of
    the item and of its answer in the longest common subsequences. Every document and
    every item is searched; a large benchmark takes several passes of about ``queries`` passages.
    Null or empty texts and items hold nothing and are found nowhere; an item
    or row without an id is searched like any other; items with equal ids count once
    per row; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    hits = [
        rows.mapInArrow(
            _listing(*prepared), "doc_id long, item_id long, cosine double, common double, answer double"
        )
        for prepared in _passes(docs, benchmark, common, queries)
    ]
    return reduce(DataFrame.unionByName, hits)


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    common: tuple[float, float, float] = (COMMON, COMMON_WITH_ANSWER, ANSWER),
    queries: int = QUERIES,
) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark, with all of their columns."""
    for prepared in _passes(docs, benchmark, common, queries):
        docs = docs.mapInArrow(_dropping(*prepared), docs.schema)
    return docs
