"""Best-fit packing of token sequences after a dominance reduction.

Only lengths decide how documents are packed, and there are as many lengths as
tokens in a sequence at most. So the plan is made over a histogram of bounded
size: sets of lengths that provably dominate every alternative are fixed for good,
and the rest goes best-fit, longest first. The plan says where the documents of a
length go by their rank among equals; the documents themselves only meet it by rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postroom.llm.common import small_batches, text_of, written
from postroom.llm.encoding import byte_batches, encoder

CAPACITY = 1024
END_ID = 2
# Pieces of one length are ranked in parts of about so many, or of the share of all
# pieces that leaves so many parts in all.
PART_ROWS, MOST_PARTS = 4_096, 65_536


@dataclass(frozen=True)
class Placement:
    """``count`` pieces of one length: ``per_sequence`` to each sequence from ``first`` on, at ``offset``."""

    length: int
    rank: int
    count: int
    per_sequence: int
    first: int
    offset: int


class _Plan:
    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, count in histogram.items():
            self.left[length] = count
        self.used = np.zeros(capacity + 1, np.int64)
        self.placements: list[Placement] = []
        self.sequences = 0
        # Open sequences by the room they have: runs of (first, number).
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int, count: int, per_sequence: int, first: int, offset: int) -> None:
        self.placements.append(
            Placement(length, int(self.used[length]), count, per_sequence, first, offset)
        )
        self.used[length] += count
        self.left[length] -= count

    def fix(self, lengths: tuple[int, ...], times: int) -> None:
        """Close ``times`` new sequences of these lengths each."""
        offset = 0
        for length in lengths:
            self.place(length, times, 1, self.sequences, offset)
            offset += length
        self.sequences += times

    def reduce(self) -> None:
        """Fix the sets that dominate all others holding their longest piece.

        A pair that fills a sequence does: whatever else went with the longer
        piece fits in the shorter one's place. So does a piece alone when nothing
        fits beside it, and with the longest that fits when no two do.
        """
        capacity = self.capacity
        if self.left[capacity]:
            self.fix((capacity,), int(self.left[capacity]))
        for long in range(capacity - 1, capacity // 2, -1):
            both = int(min(self.left[long], self.left[capacity - long]))
            if both:
                self.fix((long, capacity - long), both)
        if capacity % 2 == 0 and self.left[capacity // 2] > 1:
            self._halves()
        for long in range(capacity, 0, -1):
            while self.left[long]:
                room = capacity - long
                self.left[long] -= 1
                small = np.flatnonzero(self.left)[:2]
                fits = np.flatnonzero(self.left[: room + 1])
                two = sum(small) if len(small) > 1 and self.left[small[0]] == 1 else (
                    2 * small[0] if len(small) and self.left[small[0]] > 1 else np.inf
                )
                self.left[long] += 1
                if not len(fits):
                    self.fix((long,), int(self.left[long]) if room < long else 1)
                elif two > room:
                    best = int(fits[-1])
                    times = min(self.left[long], self.left[best]) if best != long else self.left[long] // 2
                    self.fix((long, best), int(max(1, times)))
                else:
                    break

    def _halves(self) -> None:
        half = self.capacity // 2
        pairs = int(self.left[half] // 2)
        self.placements.append(Placement(half, int(self.used[half]), 2 * pairs, 2, self.sequences, 0))
        self.used[half] += 2 * pairs
        self.left[half] -= 2 * pairs
        self.sequences += pairs

    def _fill(self, length: int, first: int, number: int, room: int) -> None:
        """Put pieces of one length into a run of sequences with equal room, as many as fit."""
        each = room // length
        count = int(min(self.left[length], number * each))
        offset = self.capacity - room
        whole, rest = divmod(count, each)
        if count:
            self.place(length, count, each, first, offset)
        if whole:
            self.open[room - each * length].append((first, whole))
        if rest:
            self.open[room - rest * length].append((first + whole, 1))
        if number - whole - (rest > 0):
            self.open[room].append((first + whole + (rest > 0), number - whole - (rest > 0)))

    def best_fit(self) -> None:
        """Longest first, each into the open sequence with the least room that does."""
        for length in range(self.capacity, 0, -1):
            for room in range(length, self.capacity + 1):
                while self.left[length] and self.open[room]:
                    first, number = self.open[room].pop()
                    self._fill(length, first, number, room)
            if self.left[length]:
                each = self.capacity // length
                number = -(-int(self.left[length]) // each)
                first = self.sequences
                self.sequences += number
                self._fill(length, first, number, self.capacity)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Placement], int]:
    """(placements, number of sequences) for so many pieces of each length up to ``capacity``."""
    found = _Plan(histogram, capacity)
    found.reduce()
    found.best_fit()
    return found.placements, found.sequences


def _cutting(path: str, end_id: int, capacity: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in byte_batches(batches, "text"):
            ids, counts = encoder(path).encode(rows.column("text").combine_chunks())
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id).astype("<u4")
            counts = counts + 1
            begins = np.cumsum(counts) - counts
            pieces = -(-counts // capacity)
            owner = np.repeat(np.arange(len(counts)), pieces)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            # The first piece takes what the others leave.
            head = counts - (pieces - 1) * capacity
            start = np.where(number > 0, head[owner] + (number - 1) * capacity, 0)
            length = np.where(number > 0, capacity, head[owner])
            at = begins[owner] + start
            crcs = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(at, length, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").combine_chunks().take(pa.array(owner)),
                    pa.array(number.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crcs, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return cut


def pieces_of(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents cut only where they are too long."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(
        _cutting(path, end_id, capacity),
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    )


def _placing(placements: list[Placement]) -> Callable:
    ordered = sorted(placements, key=lambda p: (p.length, p.rank))
    columns = np.array(
        [(p.length, p.rank, p.per_sequence, p.first, p.offset) for p in ordered], np.int64
    ).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, per, first, offset = columns.T
        # Placements of a length are runs of ranks that follow each other.
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            begin, end = np.searchsorted(lengths, length), np.searchsorted(lengths, length, "right")
            low, high = begin.copy(), end.copy()
            while (high - low > 1).any():
                middle = (low + high) // 2
                up = (ranks[middle] <= rank) & (high - low > 1)
                low, high = np.where(up, middle, low), np.where(up | (high - low <= 1), high, middle)
            nth = rank - ranks[low]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                    pa.array(first[low] + nth // per[low]),
                    pa.array(offset[low] + nth % per[low] * length),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return place


def parts_of(histogram: dict[int, int], rows: int = PART_ROWS) -> dict[int, int]:
    """In how many parts the pieces of each length are ranked: ``MOST_PARTS`` and one a length at most."""
    rows = max(rows, -(-sum(histogram.values()) // MOST_PARTS))
    return {length: -(-count // rows) for length, count in histogram.items()}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, rows: int = PART_ROWS) -> DataFrame:
    """Add (sequence_id, offset) to written ``pieces(doc_id, piece, start, length, ids_crc32)``.

    Pieces that fill a sequence are numbered where they are read. The others are ranked
    within their length, in parts of about ``rows`` that grow only once there are
    ``MOST_PARTS`` of them. The driver holds the histogram, the plan and a count a part.
    """
    spark = pieces.sparkSession
    # At most one row per length.
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    whole = histogram.pop(capacity, 0)
    placements, sequences = plan(histogram, capacity)
    full = pieces.where(F.col("length") == capacity).select(
        *pieces.columns,
        (F.monotonically_increasing_id() + sequences).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    if not histogram:
        return full
    sizes = spark.createDataFrame(sorted(parts_of(histogram, rows).items()), "length long, parts long")
    # Lengths of whole pieces are not in the table and leave here.
    salted = (
        pieces.join(F.broadcast(sizes), "length")
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts")))
        .drop("parts")
    )
    counts = salted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before, reached = [], dict.fromkeys(histogram, 0)
    for length, part, n in sorted((r["length"], r["part"], r["n"]) for r in counts.collect()):
        before.append((length, part, reached[length]))
        reached[length] += n
    offsets = spark.createDataFrame(before, "length long, part long, before long")
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("nth", F.row_number().over(order) - 1)
        .join(F.broadcast(offsets), ["length", "part"])
        .withColumn("rank", F.col("before") + F.col("nth"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    )
    placed = ranked.mapInArrow(
        _placing(placements),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
    return placed.unionByName(full) if whole else placed


def packed(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece of ``docs(doc_id, text, ...)``.

    Every row is packed: a null text counts as empty and holds the end id alone; a
    row without an id and rows with equal ids are packed as rows of their own.
    Other columns are ignored; an empty table gives an empty result. The pieces are
    written once to the shared folder, since the plan needs their lengths first.
    """
    return pack_pieces(written(pieces_of(docs, path, end_id, capacity), "pieces"), capacity)
