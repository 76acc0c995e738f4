"""Near duplicates by SimHash with bit-sliced comparison.

Fingerprints that differ in at most ``radius`` bits agree on two whole bands when
their bits are cut into ``radius + 2`` bands. So each distinct fingerprint is sent
to one bucket per pair of bands, and only neighbours in a bucket are compared. In
a bucket the bits are stored vertically, one plane per bit; a shift of the planes
pairs each fingerprint with the one so many places on, and carry-save counters add
up the differences of all pairs at once. A block of pairs is abandoned as soon as
all of its distances exceed the radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import changes, partitions, small_batches, text_of, whole_runs, written
from postroom.llm.components import components
from postroom.llm.encoding import byte_batches

WORDS = 4
RADIUS = 4
SEED = 42
BITS = 64
# Shingles whose bits are counted at a time, and pairs compared at a time.
HASHES = 1 << 17
BLOCK = 1 << 15
# Buckets of more fingerprints are compared in blocks of this many, pair by pair of blocks.
BUCKET = 8_192
RUN_BYTES = 4 * 1024 * 1024


def shingles(text: bytes, words: int) -> list[bytes]:
    """Runs of words joined by a space; fewer words than that are one run, none gives none."""
    found = text.lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-words]]).tolist()
    return [joined[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint per run of hashes: the bits set in over half of them."""
    ends = np.cumsum(counts)
    ones = np.zeros((len(counts), BITS), np.int64)
    for at in range(0, len(hashes), HASHES):
        part = hashes[at : at + HASHES].astype("<u8", copy=False)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = int(np.searchsorted(ends, at, "right"))
        last = int(np.searchsorted(ends, at + len(part) - 1, "right"))
        begins = np.maximum(ends[first : last + 1] - counts[first : last + 1] - at, 0)
        full = counts[first : last + 1] > 0
        ones[np.arange(first, last + 1)[full]] += np.add.reduceat(bits, begins[full], axis=0, dtype=np.int64)
    set_bits = (2 * ones > counts[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of all shingles, number of shingles of each text)."""
    rows = [shingles(text, words) for text in texts]
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    hashed = (h for row in rows for h in map(xxhash.xxh64_intdigest, row, repeat(SEED)))
    return np.fromiter(hashed, np.uint64, int(counts.sum())), counts


def _fingerprinting(words: int, key: str) -> Callable:
    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in byte_batches(batches, "text", RUN_BYTES):
            texts = rows.column("text").combine_chunks().cast(pa.large_binary()).to_pylist()
            hashes, counts = shingle_hashes(texts, words)
            yield pa.RecordBatch.from_arrays(
                [rows.column(key).combine_chunks(), pa.array(_majority(hashes, counts).view(np.int64))],
                names=[key, "bits"],
            )

    return fingerprint


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, bits): the 64-bit fingerprint of every whole text; null counts as empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_fingerprinting(words, "doc_id"), "doc_id long, bits long")


def _bands(radius: int) -> list[int]:
    """One mask per band."""
    edges = np.linspace(0, BITS, radius + 3).round().astype(int).tolist()
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def band_pairs(radius: int) -> list[int]:
    """Masks of which any two fingerprints within the radius agree on at least one."""
    return [a | b for a, b in combinations(_bands(radius), 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bucketed(bits: DataFrame, masks: list[int]) -> DataFrame:
    """(key, bits): each fingerprint once per mask; equal hashed keys are compared in full."""
    keys = [F.xxhash64(F.lit(i), F.col("bits").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)]
    return bits.select(F.explode(F.array(*keys)).alias("key"), "bits")


def within_radius(planes: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs differ in at most ``radius`` bits.

    ``planes[b]`` holds bit b of every fingerprint. Two planes of differences at a
    time enter the carry-save counters, which hold a pair's distance vertically.
    """
    found = np.zeros(len(left), bool)
    for at in range(0, len(left), BLOCK):
        i, j = left[at : at + BLOCK], right[at : at + BLOCK]
        counter = [np.zeros(-(-len(i) // 8), np.uint8) for _ in range(radius.bit_length() + 1)]
        over = np.zeros_like(counter[0])
        for b in range(0, len(planes), 2):
            d = np.packbits(planes[b][i] ^ planes[b][j])
            e = np.packbits(planes[b + 1][i] ^ planes[b + 1][j])
            half = counter[0] ^ d
            carry = (counter[0] & d) | (half & e)
            counter[0] = half ^ e
            for place in range(1, len(counter)):
                counter[place], carry = counter[place] ^ carry, counter[place] & carry
            over |= carry
            if b % 8 == 6 and (over | _above(counter, radius)).min() == 255:
                break
        found[at : at + BLOCK] = np.unpackbits(over | _above(counter, radius), count=len(i)) == 0
    return found


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter is above the radius."""
    above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], 255)
    for place in range(len(counter) - 1, -1, -1):
        if radius >> place & 1:
            equal = equal & counter[place]
        else:
            above = above | (equal & counter[place])
            equal = equal & ~counter[place]
    return above


def links_in(run: np.ndarray, bits: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (places of two) that connect what the radius connects within runs of equal ``run``.

    ``run`` is sorted. Pairs already connected are not compared again, and only links
    that connect something new are given: at most one per fingerprint.
    """
    size = len(bits)
    planes = np.ascontiguousarray(
        np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(size, 8), axis=1, bitorder="little").T
    )
    root = np.arange(size)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    last = np.searchsorted(run, run, "right")
    alive = np.flatnonzero(last - np.arange(size) > 1)
    shift = 1
    while len(alive):
        unlinked = alive[root[alive] != root[alive + shift]]
        hits = unlinked[within_radius(planes, unlinked, unlinked + shift, radius)]
        kept = []
        for i in hits.tolist():
            a, b = find(i), find(i + shift)
            if a != b:
                root[max(a, b)] = min(a, b)
                kept.append(i)
        if kept:
            while (flat := root[root]).tolist() != root.tolist():
                root = flat
            yield np.array(kept), np.array(kept) + shift
        shift += 1
        alive = alive[last[alive] - alive > shift]


def _runs(table: pa.Table, keys: list[str]) -> np.ndarray:
    run = np.zeros(table.num_rows, np.int64)
    run[changes(table, keys)] = 1
    return np.cumsum(run)


def _links(run: np.ndarray, bits: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    for a, b in links_in(run, bits.view(np.uint64), radius):
        none = np.zeros(len(a), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bits[a], bits[b], none)], names=["a", "b", "size"])


def _linking(radius: int, bucket: int) -> Callable:
    """Links within buckets; of a large bucket its rows instead, as (bits, key, size)."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["key"]):
            run = _runs(table, ["key"])
            size = np.bincount(run)[run]
            bits, key = (table.column(c).to_numpy() for c in ("bits", "key"))
            usual, large = np.flatnonzero((size > 1) & (size <= bucket)), np.flatnonzero(size > bucket)
            yield from _links(run[usual], bits[usual], radius)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[large]) for c in (bits, key, size)], names=["a", "b", "size"]
            )

    return link


def _linking_blocks(radius: int) -> Callable:
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["bucket", "u", "v"]):
            yield from _links(_runs(table, ["bucket", "u", "v"]), table.column("bits").to_numpy(), radius)

    return link


def fingerprint_links(bits: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect all of the distinct ``bits`` that the radius connects.

    Buckets are the pairs of bands, which miss no link.
    A bucket of more than ``bucket`` fingerprints is taken apart: its rows are dealt
    into blocks and every two blocks meet in a group of their own, so that none of
    its comparisons is left out and no task holds it whole.
    """
    n = partitions(bits.sparkSession)
    schema = "a long, b long, size long"
    first = written(
        bucketed(bits, band_pairs(radius))
        .repartition(n, "key")
        .sortWithinPartitions("key", "bits")
        .mapInArrow(_linking(radius, bucket), schema),
        "buckets",
    )
    blocks = F.ceil(F.col("size") / max(1, bucket // 2)).cast("int")
    block = F.pmod(F.xxhash64("a"), blocks).cast("int")
    other = F.col("other")
    hot = (
        first.where("size > 0")
        .select(
            F.col("a").alias("bits"), F.col("b").alias("bucket"), block.alias("block"),
            F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"),
        )
        .select("bucket", F.least("block", other).alias("u"), F.greatest("block", other).alias("v"), "bits")
        .repartition(n, "bucket", "u", "v")
        .sortWithinPartitions("bucket", "u", "v", "bits")
        .mapInArrow(_linking_blocks(radius), schema)
    )
    return first.where("size = 0").unionByName(hot).select("a", "b")


def hexadecimal(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def _least_of_component(found: DataFrame, key: str, radius: int, bucket: int) -> DataFrame:
    """(bits, least): for each fingerprint in ``found`` the smallest ``key`` in its component.

    Equal fingerprints are one class, so copies are never paired.
    """
    classes = written(found.groupBy("bits").agg(F.min(key).alias("first")), "classes")
    roots = components(fingerprint_links(classes.select("bits"), radius, bucket))
    rooted = classes.join(roots, F.col("bits") == F.col("node"), "left").select(
        "bits", "first", F.coalesce("root", "bits").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    return rooted.join(least, "root").select("bits", "least")


def near_duplicates(
    docs: DataFrame, words: int = WORDS, radius: int = RADIUS, bucket: int = BUCKET
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs(doc_id, text, ...)``.

    ``component_id`` is the smallest id reachable over links between fingerprints
    that differ in at most ``radius`` bits. A null text counts as empty; texts
    without a word have fingerprint zero and are linked like any other. Rows with equal ids are
    rows of their own; a row without an id belongs to its component, whose id is the
    smallest there is, or null. Other columns are ignored; an empty table gives an
    empty result.
    """
    found = written(fingerprints(docs, words), "fingerprints")
    of_class = _least_of_component(found, "doc_id", radius, bucket)
    return found.join(of_class, "bits").select(
        "doc_id", hexadecimal(F.col("bits")).alias("fingerprint"), F.col("least").alias("component_id")
    )


def kept_of_near(
    docs: DataFrame, words: int = WORDS, radius: int = RADIUS, bucket: int = BUCKET
) -> DataFrame:
    """(doc_id, version, kept): of each component, as ``near_duplicates`` has them, one document stays.

    It is the row of smallest id; rows without an id come after all others. ``version``
    is a hash of the text: of rows with equal id the smallest version stays, and of rows
    repeated as a whole ``kept`` says so of all. Null texts count as empty; an empty
    table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.struct(
            F.col("doc_id").isNull().alias("last"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64(text_of()).alias("version"),
        ).alias("row"),
        text_of().alias("text"),
    )
    kind = "row struct<last: boolean, doc_id: bigint, version: bigint>, bits long"
    found = written(rows.mapInArrow(_fingerprinting(words, "row"), kind), "fingerprints")
    return found.join(_least_of_component(found, "row", radius, bucket), "bits").select(
        "row.doc_id", "row.version", (F.col("row") == F.col("least")).alias("kept")
    )
