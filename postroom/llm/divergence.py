"""How the words of each source differ from those of other sources and of its language.

Counts of kept terms form a sparse matrix per language, a row per source. Its tiles
are held as k-squared trees (k = 2): a node is a quadrant, has four bits for its
quarters, and quarters without a count are not there. To compare all sources of two
rows of tiles, both trees are walked together: where both quadrants are empty, every
pair of their sources differs by the same amount in each column, so they are priced
by their width alone; only leaves in which either has a count are compared cell by cell.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postroom.llm.common import small_batches, text_of, written
from postroom.llm.encoding import byte_batches

DOCUMENTS = 30
TOP_TERMS = 50
SMOOTHING = 5
UNIT = 1_000_000_000
# Sources and terms of a tile, and the side of a leaf as a power of two.
ROWS, COLUMNS = 128, 2_048
LEAF_BITS = 3
LEAF = 1 << LEAF_BITS
# Texts are taken apart in runs of about this many bytes, and compared leaves at a time.
RUN_BYTES = 1 << 20
LEAVES = 4_096
BATCH_BYTES = 4 * 1024 * 1024

# Letters are ASCII letters, lower-cased, and every byte of other characters.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_runs(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about ``RUN_BYTES``; no term is cut."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = len(folded) if len(folded) - at <= RUN_BYTES else folded.find(b" ", at + RUN_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, d): occurrences and documents of each term in a batch of texts;
    a row without a term says that the group occurs."""
    for rows in byte_batches(batches, "text", BATCH_BYTES):
        texts = rows.column("text").combine_chunks().cast(pa.large_binary())
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        names = zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), strict=True)
        for i, name in enumerate(names):
            n, d = groups.setdefault(name, (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in word_runs(texts[i].as_py()):
                n.update(words)
                seen.update(words)
            d.update(seen)
        for (lang, source), (n, d) in groups.items():
            size = len(n) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * size, pa.string()),
                    pa.array([source] * size, pa.string()),
                    pa.array([None, *n], pa.binary()).cast(pa.string()),
                    pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *(d[term] for term in n)], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "d"],
            )


def _interleaved(row: np.ndarray, column: np.ndarray, bits: int) -> np.ndarray:
    code = np.zeros(len(row), np.int64)
    for b in range(bits):
        code |= ((row >> b & 1) << (2 * b + 1)) | ((column >> b & 1) << (2 * b))
    return code


class Tree:
    """A k-squared tree over cells (row, column) of a square of 2**depth leaves a side.

    ``bits[l]`` has four bits per node of level l + 1, one per quarter; ``ranks[l]`` says
    which node of level l a set bit leads to. Level 0 are the leaves, the last the root.
    """

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, least: np.ndarray, depth: int):
        codes = _interleaved(row >> LEAF_BITS, column >> LEAF_BITS, depth)
        nodes = np.unique(codes)
        self.least = least.reshape(-1, LEAF)
        self.leaves = np.repeat(np.zeros((len(nodes), LEAF, 1), np.int64), LEAF, axis=2)
        first = np.zeros(len(nodes), np.int64)
        place = np.searchsorted(nodes, codes)
        first[place] = row >> LEAF_BITS
        if len(nodes):
            self.leaves += self.least[first][:, :, None]
            self.leaves[place, row % LEAF, column % LEAF] = value
        self.bits, self.ranks = [], []
        for _ in range(depth):
            above = np.unique(nodes >> 2)
            bits = np.zeros(4 * len(above), bool)
            bits[4 * np.searchsorted(above, nodes >> 2) + (nodes & 3)] = True
            self.bits.append(bits)
            self.ranks.append(np.cumsum(bits) - 1)
            nodes = above
        self.empty = len(nodes) == 0

    def quarter(self, level: int, node: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The node below ``node`` of ``level``, or -1 where there is none."""
        found = np.full(len(node), -1)
        held = np.flatnonzero(node >= 0)
        if len(held):
            at = 4 * node[held] + which[held]
            bits = self.bits[level - 1][at]
            found[held[bits]] = self.ranks[level - 1][at[bits]]
        return found

    def leaf(self, node: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Prices of the cells of leaves; one that is not there has the least price of its rows."""
        cells = np.repeat(self.least[row][:, :, None], LEAF, axis=2)
        held = node >= 0
        cells[held] = self.leaves[node[held]]
        return cells


def differences(left: Tree, right: Tree, depth: int, rows: tuple[int, int], columns: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of differences over leaves with counts, columns priced by width) for all pairs of rows."""
    same = left is right
    tall = [-(-r // LEAF) for r in rows]
    total = np.zeros((tall[0], tall[1], LEAF, LEAF), np.int64)
    empty = np.zeros((tall[0] * LEAF, tall[1] * LEAF), np.int64)
    i = j = c = np.zeros(1, np.int64)
    a, b = (np.full(1, -1 if t.empty else 0) for t in (left, right))
    for level in range(depth, -1, -1):
        side = LEAF << level
        nothing = (a < 0) & (b < 0)
        if nothing.any():
            width = np.clip(columns - c[nothing] * side, 0, side)
            priced = np.zeros((-(-tall[0] * LEAF // side), -(-tall[1] * LEAF // side)), np.int64)
            np.add.at(priced, (i[nothing], j[nothing]), width)
            empty += np.repeat(np.repeat(priced, side, 0)[: len(empty)], side, 1)[:, : empty.shape[1]]
        i, j, c, a, b = (x[~nothing] for x in (i, j, c, a, b))
        if level == 0:
            break
        parts = []
        for di in (0, 1):
            for dj in (0, 1):
                for dc in (0, 1):
                    u, v, w = 2 * i + di, 2 * j + dj, 2 * c + dc
                    below = side >> 1
                    real = (u * below < rows[0]) & (v * below < rows[1]) & (w * below < columns)
                    if same:
                        real &= u <= v
                    x = left.quarter(level, a[real], np.full(int(real.sum()), 2 * di + dc))
                    y = right.quarter(level, b[real], np.full(int(real.sum()), 2 * dj + dc))
                    parts.append((u[real], v[real], w[real], x, y))
        i, j, c, a, b = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.lexsort((j, i))
    for at in range(0, len(order), LEAVES):
        part = order[at : at + LEAVES]
        x, y = left.leaf(a[part], i[part]), right.leaf(b[part], j[part])
        real = c[part, None] * LEAF + np.arange(LEAF) < columns
        apart = np.abs(x[:, :, None, :] - y[:, None, :, :]) * real[:, None, None, :]
        np.add.at(total, (i[part], j[part]), apart.sum(axis=3))
    return total.transpose(0, 2, 1, 3).reshape(empty.shape), empty


def compared(table: pa.Table, tall: int = ROWS) -> pa.Table:
    """All pairs of sources of one tile: (lang, a, b, p_a, p_b, apart, columns).

    Rows without a term bring a source and its price of a term it lacks.
    """
    term = table.column("term").combine_chunks()
    marks = term.is_null().to_numpy(zero_copy_only=False)
    number, least = (table.column(c).to_numpy() for c in ("number", "least"))
    source = np.array(table.column("source").to_pylist(), object)
    cells = table.filter(pa.array(~marks))
    coded = cells.column("term").combine_chunks().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    columns = len(coded.dictionary)
    # Frequent terms first: what is left of each row is then empty in whole quadrants.
    weight = np.zeros(columns, np.int64)
    weight[code] = cells.column("total").to_numpy()
    place = np.empty(columns, np.int64)
    place[np.lexsort((np.array(coded.dictionary.to_pylist(), object), -weight)) if columns else []] = np.arange(columns)
    column = place[code]
    u, v = table.column("u")[0].as_py(), table.column("v")[0].as_py()
    depth = max(0, int(np.ceil(np.log2(max(tall, columns, 1) / LEAF))))
    sides = []
    for tile in (u, v) if u != v else (u,):
        rows = np.flatnonzero(marks & (number // tall == tile))
        rows = rows[np.argsort(number[rows])]
        price = np.zeros(-(-max(1, len(rows)) // LEAF) * LEAF, np.int64)
        price[: len(rows)] = least[rows]
        mine = cells.column("number").to_numpy() // tall == tile
        tree = Tree(
            cells.column("number").to_numpy()[mine] % tall, column[mine], cells.column("price").to_numpy()[mine], price, depth
        )
        sides.append((tree, source[rows], least[rows]))
    (left, names_a, least_a), (right, names_b, least_b) = sides[0], sides[-1]
    apart, empty = differences(left, right, depth, (len(names_a), len(names_b)), columns)
    apart = apart[: len(names_a), : len(names_b)] + empty[: len(names_a), : len(names_b)] * np.abs(
        least_a[:, None] - least_b
    )
    i, j = np.triu_indices(len(names_a), 1) if u == v else map(np.ravel, np.indices(apart.shape))
    return pa.table(
        {
            "lang": pa.array([table.column("lang")[0].as_py()] * len(i), pa.string()),
            "a": pa.array(names_a[i], pa.string()),
            "b": pa.array(names_b[j], pa.string()),
            "p_a": pa.array(least_a[i]),
            "p_b": pa.array(least_b[j]),
            "apart": pa.array(apart[i, j]),
            "columns": pa.array(np.full(len(i), columns)),
        }
    )


def _price(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exact; 0 without terms."""
    above = (count + SMOOTHING).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = (total + SMOOTHING * terms).cast("decimal(20,0)")
    whole = F.call_function("div", above, below)
    return F.when(terms > 0, 1 + whole).otherwise(F.lit(0)).cast("long")


def _ranked(rows: DataFrame) -> DataFrame:
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(best))


def _pairs(cells: DataFrame, groups: DataFrame, columns: int, tall: int) -> DataFrame:
    """(lang, a, b, value) once for every two sources of a language."""
    blocks = F.greatest(F.ceil(F.col("terms") / columns), F.lit(1)).cast("int")
    tile = F.floor(F.col("number") / tall).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / tall).cast("int"))).alias("other")
    marks = groups.select(
        "lang", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "number", "source", "least", "sources",
        F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("price"), F.lit(0).cast("long").alias("total"),
    )
    priced = cells.select(
        "lang", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), "number",
        F.lit(None).cast("string").alias("source"), "least", "sources", "term", "price", "total",
    )
    tiles = (
        priced.unionByName(marks)
        .select("lang", "block", "number", "source", "least", "term", "price", "total", tile.alias("tile"), other)
        .withColumn("u", F.least("tile", "other"))
        .withColumn("v", F.greatest("tile", "other"))
        .drop("tile", "other")
    )
    parts = tiles.groupBy("lang", "block", "u", "v").applyInArrow(
        lambda table: compared(table, tall), "lang string, a string, b string, p_a long, p_b long, apart long, columns long"
    )
    whole = parts.groupBy("lang", "a", "b", "p_a", "p_b").agg(F.sum("apart").alias("apart"), F.sum("columns").alias("columns"))
    terms = groups.select("lang", "terms").distinct()
    missing = (F.col("terms") - F.col("columns")) * F.abs(F.col("p_a") - F.col("p_b"))
    return whole.join(terms, "lang").select("lang", "a", "b", (F.col("apart") + missing).alias("value"))


def source_divergence(
    docs: DataFrame, documents: int = DOCUMENTS, top: int = TOP_TERMS, columns: int = COLUMNS, rows: int = ROWS
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group (lang, source) of ``docs(text, lang, source, ...)``.

    Terms are runs of letters, A to Z lower-cased; a language keeps those of at least
    ``documents`` of its rows. A group's price of a term is its smoothed share in whole
    billionths. Part ``pair`` gives the sum of differences of prices to every other source
    of the language; part ``term`` the ``top`` terms a group has and prices above its
    language. Ties go to the smaller item by its bytes. A null text, lang or source
    counts as empty; repeated rows count each; a language without kept terms has pairs
    of value 0; a source alone in its language has none. Other columns are ignored; an
    empty table gives an empty result.

    Counts are added up per batch and before the shuffle. A task compares at most
    ``rows`` sources with as many others over some ``columns`` terms.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of().alias("text"))
    counted = written(
        texts.mapInArrow(_counting, "lang string, source string, term string, n long, d long")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("d").alias("d")),
        "counted",
    )
    seen = counted.where("term IS NOT NULL")
    kept = (
        seen.groupBy("lang", "term")
        .agg(F.sum("d").alias("d"), F.sum("n").alias("total"))
        .where(F.col("d") >= documents)
        .drop("d")
    )
    cells = written(seen.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "cells")
    # A row of a language's own per term: its total over all sources, which every cell carries.
    langs = cells.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("total").alias("all")
    )
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("mine"))
    by_source = Window.partitionBy("lang")
    groups = written(
        counted.where("term IS NULL")
        .select("lang", "source")
        .join(totals, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .na.fill(0, ["mine", "terms", "all"])
        .withColumn("least", _price(F.lit(0), F.col("mine"), F.col("terms")))
        .withColumn("number", F.row_number().over(by_source.orderBy("source")) - 1)
        .withColumn("sources", F.count(F.lit(1)).over(by_source)),
        "groups",
    )
    priced = written(
        cells.join(groups, ["lang", "source"]).withColumn("price", _price(F.col("n"), F.col("mine"), F.col("terms"))),
        "priced",
    )
    pairs = _pairs(priced, groups, columns, rows)
    both = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    part_pair = both.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    above = F.col("price") - _price(F.col("total"), F.col("all"), F.col("terms"))
    part_term = priced.select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), above.alias("value")
    ).where("value > 0")
    ranked = _ranked(part_pair).unionByName(_ranked(part_term).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
