"""What each of five filters removes, in every order they can be applied in.

Four filters look at one text. The fifth asks for an identical text under a smaller
id, over the whole table: texts are range-partitioned by prefixes that are as long as
they must be to part a sample evenly, and every range is inserted in a compressed
trie whose terminals hold the smallest id. A document's failures are then five bits,
and the counts of all orders follow from how many documents have each set of bits.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import partitions, small_batches, text_of, written
from postroom.llm.encoding import byte_batches

FILTERS = "ABCDE"
WORDS = 200
REPEATED = 1 << FILTERS.index("E")
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"
# Texts that a scan task makes distinct at a time, and bytes of texts in one trie.
BATCH_BYTES = 8 * 1024 * 1024
TRIE_BYTES = 48 * 1024 * 1024
# Prefixes that ranges are parted by: a sample of at most so many, each of at most so many characters.
SAMPLE, PREFIX = 32_768, 256
# Runs of words that a long text is taken apart in, by bytes.
RUN_BYTES = 1 << 20
_SPACES = b" \t\n\r\x0b\x0c"


def word_counts(text: bytes) -> tuple[int, int]:
    """(words, distinct words); a long text is taken apart run by run."""
    if len(text) <= RUN_BYTES:
        words = text.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(text):
        end = min(len(text), at + RUN_BYTES)
        while end < len(text) and text[end] not in _SPACES:
            end += 1
        words = text[at:end].split()
        n, at = n + len(words), end
        seen.update(words)
    return n, len(seen)


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    n, distinct = word_counts(text)
    capitals = len(text) - len(text.translate(None, _UPPER))
    # Bytes that continue a character are no code points of their own.
    points = len(text) - int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80))
    return (
        (n < WORDS)
        | (100 * distinct < 50 * n) << 1
        | (100 * capitals > 3 * points) << 2
        | (len(text.translate(None, _SYMBOLS)) < len(text)) << 3
    )


def adaptive_prefixes(sample: list[bytes], parts: int) -> list[bytes]:
    """Splitters of ``parts`` ranges: each the shortest prefix that parts its neighbours in the sample."""
    texts = sorted(set(sample))
    found = []
    for part in range(1, min(parts, len(texts))):
        at = part * len(texts) // min(parts, len(texts))
        before, here = texts[at - 1], texts[at]
        same = next((i for i, (a, b) in enumerate(zip(before, here, strict=False)) if a != b), min(len(before), len(here)))
        found.append(here[: same + 1])
    return sorted(set(found))


class Trie:
    """Texts in a compressed trie; an edge is the longest run of bytes without a branch."""

    def __init__(self) -> None:
        # A node is [edge into it, nodes below by their first byte, smallest id of its text, rows of its text].
        self.root: list = [b"", {}, None, None]

    def insert(self, text: bytes, number: int, row: tuple) -> None:
        """Add a row under its text; the terminal keeps the smallest id."""
        node, at = self.root, 0
        while at < len(text):
            below = node[1].get(text[at])
            if below is None:
                below = node[1][text[at]] = [text[at:], {}, None, None]
            elif not text.startswith(below[0], at):
                below = self._parted(node, below, _shared(below[0], text, at))
            node, at = below, at + len(below[0])
        if node[3] is None:
            node[2], node[3] = number, []
        node[2] = min(node[2], number)
        node[3].append((number, row))

    @staticmethod
    def _parted(node: list, below: list, same: int) -> list:
        """Put a node into the edge above ``below`` after ``same`` bytes."""
        edge = below[0]
        middle = [edge[:same], {edge[same]: below}, None, None]
        below[0] = edge[same:]
        node[1][edge[0]] = middle
        return middle

    def repeated(self) -> Iterator[tuple[bool, tuple]]:
        """(has a smaller id the same text?, row) of all rows, terminal by terminal."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            for number, row in node[3] or ():
                yield node[2] < number, row
            stack += node[1].values()


def _shared(edge: bytes, text: bytes, at: int) -> int:
    """How many bytes of ``edge`` stand in ``text`` from ``at`` on; by halving, so that slices are compared."""
    low, high = 0, min(len(edge), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(edge[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def _marking(prefixes: list[bytes], cuts: int, batch_bytes: int) -> Callable:
    """(part, cut, doc_id, lang, mask, copies, text): failures of each document.

    Of equal texts within a batch, only rows of the smallest id still have to meet those of
    other batches and bring their text; the others fail for certain.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        dealt = 0
        for rows in byte_batches(batches, "text", batch_bytes):
            texts = rows.column("text").combine_chunks().cast(pa.large_binary()).to_pylist()
            ids, langs = rows.column("doc_id").to_pylist(), rows.column("lang").to_pylist()
            least: dict[bytes, int] = {}
            for text, number in zip(texts, ids, strict=True):
                if number is not None and number <= least.get(text, number):
                    least[text] = number
            masks = {text: failures(text) for text in set(texts)}
            open_rows: dict[tuple, int] = {}
            settled: dict[tuple, int] = {}
            for text, number, lang in zip(texts, ids, langs, strict=True):
                if number is not None and number == least[text]:
                    key = (text, number, lang)
                    open_rows[key] = open_rows.get(key, 0) + 1
                else:
                    key = (number, lang, masks[text] | (0 if number is None else REPEATED))
                    settled[key] = settled.get(key, 0) + 1
            out = [
                (bisect.bisect_right(prefixes, text), xxhash.xxh64_intdigest(text) % cuts, number, lang, masks[text], n, text)
                for (text, number, lang), n in open_rows.items()
            ]
            for (number, lang, mask), n in settled.items():
                dealt += 1
                out.append((dealt % (len(prefixes) + 1), 0, number, lang, mask, n, None))
            if out:
                yield _batch(out)

    return mark


_MARKED = pa.schema(
    [
        ("part", pa.int32()), ("cut", pa.int32()), ("doc_id", pa.int64()), ("lang", pa.string()),
        ("mask", pa.int32()), ("copies", pa.int64()), ("text", pa.large_binary()),
    ]
)
_MARKED_DDL = "part int, cut int, doc_id long, lang string, mask int, copies long, text binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MARKED, strict=True)]
    columns[-1] = columns[-1].cast(pa.binary())
    return pa.RecordBatch.from_arrays(columns, names=_MARKED.names)


def _judging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, mask, copies): rows come sorted by part and cut, and each has a trie of its own."""
    here, trie, settled = None, Trie(), []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("part", "cut", "text", "doc_id", "lang", "mask", "copies"))
        for part, cut, text, *row in zip(*columns, strict=True):
            if (part, cut) != here:
                yield from _judged(trie, settled)
                here, trie, settled = (part, cut), Trie(), []
            if text is None:
                settled.append(tuple(row))
            else:
                trie.insert(text, row[0], tuple(row))
    yield from _judged(trie, settled)


def _judged(trie: Trie, settled: list[tuple]) -> Iterator[pa.RecordBatch]:
    rows = settled + [
        (number, lang, mask | (REPEATED if again else 0), n) for again, (number, lang, mask, n) in trie.repeated()
    ]
    if rows:
        kinds = {"doc_id": pa.int64(), "lang": pa.string(), "mask": pa.int32(), "copies": pa.int64()}
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], names=list(kinds)
        )


def failure_masks(
    docs: DataFrame, trie_bytes: int = TRIE_BYTES, sample: int = SAMPLE, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """(doc_id, lang, mask, copies): the filters that the rows of ``docs(doc_id, text, lang, ...)`` fail, as bits from A on.

    ``copies`` rows have the same id, language and failures. Ranges of texts are as many
    as the shuffle has partitions; where one holds more than ``trie_bytes`` it is cut by
    a hash of whole texts, so a trie's memory does not grow with the table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of("lang").alias("lang"), text_of().alias("text")
    )
    prefixes, size = _splitters(rows, partitions(spark), sample)
    cuts = max(1, -(-2 * size // (trie_bytes * (len(prefixes) + 1))))
    parts = len(prefixes) + 1
    return (
        rows.mapInArrow(_marking(prefixes, cuts, batch_bytes), _MARKED_DDL)
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions("part", "cut")
        .mapInArrow(_judging, "doc_id long, lang string, mask int, copies long")
    )


def _splitters(rows: DataFrame, parts: int, sample: int) -> tuple[list[bytes], int]:
    """(adaptive prefixes, bytes of all texts).

    What reaches the driver is at most ``sample`` prefixes of 256 characters, those of
    the smallest hashes among distinct texts' prefixes; they only even out the ranges.
    """
    texts = rows.select(F.substring("text", 1, PREFIX).alias("prefix"), F.xxhash64("text").alias("hash"), F.octet_length("text").cast("long").alias("n"))
    size = texts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    wanted = min(sample, 64 * parts)
    # One in so many hashes is taken, so that copies of a text count once and little is shuffled.
    share = max(1, size["rows"] // (4 * wanted))
    drawn = (
        texts.where(F.pmod("hash", F.lit(share)) == 0)
        .select("prefix", "hash")
        .distinct()
        .orderBy("hash")
        .limit(wanted)
    )
    return adaptive_prefixes([row["prefix"].encode() for row in drawn.collect()], parts), size["bytes"]


def _orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bits of the filters before, bit of the filter) of all orders."""
    return [
        ("".join(order), i + 1, sum(1 << FILTERS.index(f) for f in order[:i]), 1 << FILTERS.index(f))
        for order in permutations(FILTERS)
        for i, f in enumerate(order)
    ]


def _steps() -> Column:
    return F.array(
        *(
            F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"), F.lit(f).alias("bit"))
            for o, s, b, f in _orders()
        )
    )


def filter_interactions(docs: DataFrame, labels: DataFrame, trie_bytes: int = TRIE_BYTES, sample: int = SAMPLE) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row per value of ``lang``, order of the filters and step. A null text or lang is
    empty. A row fails E if a smaller id has its very text; rows of equal id don't make
    each other fail, and a row without an id neither fails E nor makes another fail.
    Repeated rows count each. A document is good (toxic) if any of its rows in
    ``labels(doc_id, quality, toxic)`` says 1; null labels and labels without a document
    do no harm. Other columns are ignored; an empty table gives an empty result.

    Only ids, masks and labels meet; texts travel once, those not settled within their batch.
    """
    marked = (
        failure_masks(docs, trie_bytes, sample)
        .groupBy("doc_id", "lang", "mask")
        .agg(F.sum("copies").alias("copies"))
    )
    label = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    )
    n = F.col("copies")
    # At most 32 sets of failures a language.
    sets = written(
        marked.join(label, "doc_id", "left")
        .groupBy(F.col("lang").alias("part"), "mask")
        .agg(
            F.sum(n).alias("n"),
            F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"),
        ),
        "failures",
    )
    mask, before, bit = F.col("mask"), F.col("order.before"), F.col("order.bit")
    fails, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
    removed = fails & ~earlier

    def total(where: Column, of: str = "n") -> Column:
        return F.sum(F.when(where, F.col(of)).otherwise(0)).cast("long")

    # In the orders of all five, one in as many as fail has this filter before the others that fail.
    first = F.expr("120 div greatest(bit_count(mask), 1)")
    return (
        sets.withColumn("order", F.explode(_steps()))
        .groupBy("part", F.col("order.filter_order").alias("filter_order"), F.col("order.step").alias("step"))
        .agg(
            total(~fails & ~earlier).alias("kept"),
            total(removed).alias("removed"),
            total(fails & earlier).alias("redundant"),
            total(mask == bit).alias("unique_fails"),
            total(removed, "good").alias("good_lost"),
            total(removed, "toxic").alias("toxic_lost"),
            F.sum(F.when(fails, F.col("n") * first).otherwise(0)).cast("long").alias("shapley"),
        )
    )
