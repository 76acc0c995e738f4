"""Exact search of the vectors with the largest inner products.

Queries and candidates are dealt into cells: every block of queries meets every
shard of candidates in one task, which holds the queries and streams the candidates.
There a block of candidates lies vertically, a row per dimension. Inner products
grow by a block of dimensions at a time; what the dimensions not yet read can still
add is at most the product of both remaining norms, so a pair whose bound is below
the k-th score of its query is dropped, and the pairs that survive are compacted
before the next dimensions are read. All scores are integers and exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postroom.llm.common import changes, partitions, written

SCALE = 64
# A cell holds at most so many queries, or so many bytes of them, and their best scores.
QUERIES, QUERY_BYTES = 16_384, 16 * 1024 * 1024
# Candidates of a shard: no fewer than the first, to save copies of queries, no more than the second.
LEAST_SHARD, MOST_SHARD = 4_096, 1 << 20
TILE = 256
BLOCK = 4_096
DIMENSIONS = 16
# Below this share of living pairs they are compacted one by one, above it by columns.
SPARSE = 1 / 16
SINGLE, DOUBLE = float(1 << 24), float(1 << 53)
_MOST, _LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _quantising(scale: int) -> Callable:
    """(vec_id, dim, mass, vec, deal): whole numbers as 4-byte floats where those hold them, else 8-byte."""

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = 0
        for batch in batches:
            lists = batch.column("embedding")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(scale * flat)
            ends = np.cumsum(size)
            starts = ends - size
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            whole = (odd[ends] == odd[starts]) & lists.is_valid().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(whole & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False))
            vectors = [flat[starts[i] : ends[i]] + 0.0 for i in rows]
            with np.errstate(over="ignore"):
                mass = [float(v @ v) for v in vectors]
            packed = [v.astype("<f4" if np.abs(v).max(initial=0) < SINGLE else "<f8").tobytes() for v in vectors]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(rows)),
                    pa.array(size[rows].astype(np.int32)),
                    pa.array(mass, pa.float64()),
                    pa.array(packed, pa.binary()),
                    pa.array(dealt + np.arange(len(rows))),
                ],
                names=["vec_id", "dim", "mass", "vec", "deal"],
            )
            dealt += len(rows)

    return quantise


def _matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    """A row per vector, in the narrower type if all of them fit it."""
    if all(len(v) == 4 * dim for v in vectors):
        return np.frombuffer(b"".join(vectors), "<f4").reshape(len(vectors), dim)
    rows = [np.frombuffer(v, "<f4" if len(v) == 4 * dim else "<f8").astype(np.float64) for v in vectors]
    return np.stack(rows)


def _exact_type(q: np.ndarray, c: np.ndarray) -> tuple[type, float]:
    """(a type in which every partial sum is exact, the most that a score can be)."""
    dim = q.shape[1]
    most = dim * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0))
    return (np.float32 if most < SINGLE else np.float64 if most < DOUBLE else object), most


class Tile:
    """Some queries with the best scores each has met so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.scores = np.full((len(ids), k), _LEAST)
        self.found = np.full((len(ids), k), _MOST)
        self.full = np.zeros(len(ids), np.int64)
        # Dimensions in which these queries weigh most come first.
        order = np.argsort(-np.abs(queries).sum(axis=0), kind="stable")
        self.steps = [order[at : at + DIMENSIONS] for at in range(0, len(order), DIMENSIONS)]
        self.rest = self._rests(queries.T)

    def _rests(self, columns: np.ndarray) -> list[np.ndarray]:
        """After each step, the norm of every vector's remaining dimensions."""
        left = [np.zeros(columns.shape[1])]
        for step in reversed(self.steps[1:]):
            part = columns[step].astype(np.float64)
            left.append(left[-1] + np.einsum("dn,dn->n", part, part))
        return [np.sqrt(r) for r in reversed(left)]

    def meet(self, ids: np.ndarray, columns: np.ndarray) -> None:
        """Take the candidates ``columns`` (a row per dimension) into account."""
        kind, most = _exact_type(self.queries, columns)
        if kind is object or not self.steps:
            self._plainly(ids, columns)
            return
        slack = 2 + 1e-6 * most
        q, c = self.queries.astype(kind), columns.astype(kind, copy=False)
        rest = [r.astype(kind) for r in self._rests(columns)]
        worst = np.where(self.full >= self.k, self.scores[:, -1], -np.inf).astype(kind) - kind(slack)
        acc = q[:, self.steps[0]] @ c[self.steps[0]]
        for at, step in enumerate(self.steps[1:]):
            left = self.rest[at].astype(kind) * kind(1 + 1e-5)
            living = acc + left[:, None] * rest[at] >= worst[:, None]
            share = np.count_nonzero(living) / living.size
            if share == 0:
                return
            if share < SPARSE:
                i, j = np.nonzero(living)
                self._pairs(ids, q, c, rest, worst, i, j, acc[i, j], at + 1)
                return
            columns_left = living.any(axis=0)
            if np.count_nonzero(columns_left) < 0.75 * len(ids):
                ids, acc, c = ids[columns_left], acc[:, columns_left], c[:, columns_left]
                rest = [r[columns_left] for r in rest]
            acc += q[:, step] @ c[step]
        own = self.ids[:, None] == ids
        acc[own] = -np.inf
        least = worst
        if len(ids) > self.k:
            least = np.maximum(worst, np.partition(acc, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        i, j = np.nonzero((acc >= least[:, None]) & ~own)
        self._merge(i, acc[i, j].astype(np.int64), ids[j])

    def _pairs(
        self, ids: np.ndarray, q: np.ndarray, c: np.ndarray, rest: list[np.ndarray], worst: np.ndarray,
        i: np.ndarray, j: np.ndarray, score: np.ndarray, at: int,
    ) -> None:
        """The steps from ``at`` on, for the living pairs (i, j) alone."""
        while True:
            step = self.steps[at]
            score = score + np.einsum("pd,dp->p", q[i][:, step], c[step][:, j])
            bound = score + self.rest[at][i].astype(score.dtype) * score.dtype.type(1 + 1e-5) * rest[at][j]
            living = bound >= worst[i]
            i, j, score, at = i[living], j[living], score[living], at + 1
            if not len(i):
                return
            if at == len(self.steps):
                break
        other = self.ids[i] != ids[j]
        self._merge(i[other], score[other].astype(np.int64), ids[j[other]])

    def _plainly(self, ids: np.ndarray, columns: np.ndarray) -> None:
        """Whole numbers of any size; a score beyond 64 bits counts as the nearest that fits."""
        c = np.array([[int(x) for x in row] for row in columns.tolist()], object).reshape(columns.shape)
        for i, query in enumerate(self.queries.tolist()):
            scores = np.zeros(len(ids), object)
            for d, x in enumerate(query):
                scores = scores + int(x) * c[d]
            clipped = np.array([max(_LEAST + 1, min(_MOST, s)) for s in scores], np.int64)
            other = ids != self.ids[i]
            self._merge(np.full(int(other.sum()), i), clipped[other], ids[other])

    def _merge(self, i: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(i):
            return
        rows = np.concatenate([np.repeat(np.arange(len(self.ids)), self.k), i])
        every = np.concatenate([self.scores.ravel(), scores])
        names = np.concatenate([self.found.ravel(), ids])
        # ~x falls as x rises and fits whatever x is.
        order = np.lexsort((names, ~every, rows))
        rows, every, names = rows[order], every[order], names[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
        shape = (len(self.ids), self.k)
        self.scores, self.found = every[best].reshape(shape), names[best].reshape(shape)
        self.full = np.minimum(self.full + np.bincount(i, minlength=len(self.ids)), self.k)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of the scores held."""
        row, rank = np.nonzero(np.arange(self.k) < self.full[:, None])
        return row, self.found[row, rank], self.scores[row, rank]


def foremost(ids: np.ndarray, matrix: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the k best of any query.

    Rows are sorted by vector and id. Of equal vectors, which tie with each other,
    only the k + 1 smallest ids can be, the query's own among them, and k rows of each id.
    """
    new = np.ones(len(ids), bool)
    new[1:] = (matrix[1:] != matrix[:-1]).any(axis=1)
    other = new.copy()
    other[1:] |= ids[1:] != ids[:-1]
    places = np.arange(len(ids))
    number = np.cumsum(other)
    rank = number - number[np.maximum.accumulate(np.where(new, places, 0))]
    copy = places - np.maximum.accumulate(np.where(other, places, 0))
    return np.flatnonzero((rank <= k) & (copy < k))


class Cell:
    """The queries of one cell, by their number of dimensions, and the candidates waiting."""

    def __init__(self, k: int):
        self.k = k
        self.asked: dict[int, list[tuple]] = {}
        self.tiles: dict[int, list[tuple[Tile, list[tuple]]]] = {}
        self.waiting: list[tuple[np.ndarray, list[bytes]]] = []
        self.dim, self.rows = -1, 0

    def ask(self, dim: int, rows: list[tuple]) -> None:
        self.asked.setdefault(dim, []).extend(rows)

    def _tiles(self, dim: int) -> list[tuple[Tile, list[tuple]]]:
        if dim not in self.tiles:
            rows = self.asked.get(dim, [])
            matrix = _matrix([r[-1] for r in rows], dim) if rows else np.zeros((0, dim))
            # Queries that weigh most in the same dimension share a tile.
            order = np.argsort(np.abs(matrix).argmax(axis=1), kind="stable") if dim and len(rows) else np.arange(len(rows))
            self.tiles[dim] = [
                (Tile(np.array([rows[i][0] for i in part]), matrix[part], self.k), [rows[i] for i in part])
                for part in (order[at : at + TILE] for at in range(0, len(order), TILE))
            ]
        return self.tiles[dim]

    def offer(self, dim: int, ids: np.ndarray, vectors: list[bytes]) -> None:
        if dim != self.dim:
            self.flush()
            self.dim = dim
        self.waiting.append((ids, vectors))
        self.rows += len(ids)
        if self.rows >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.rows and self._tiles(self.dim):
            every = np.concatenate([i for i, _ in self.waiting])
            matrix = _matrix([v for _, vs in self.waiting for v in vs], self.dim)
            kept = foremost(every, matrix, self.k)
            for at in range(0, len(kept), BLOCK):
                part = kept[at : at + BLOCK]
                columns = np.ascontiguousarray(matrix[part].T)
                for tile, _ in self._tiles(self.dim):
                    tile.meet(every[part], columns)
        self.waiting, self.rows = [], 0

    def best(self) -> Iterator[pa.RecordBatch]:
        self.flush()
        for tiles in self.tiles.values():
            for tile, rows in tiles:
                row, found, scores = tile.best()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(tile.ids[row]),
                        pa.array([rows[i][1] for i in row], pa.int64()),
                        pa.array([rows[i][2] for i in row], pa.int64()),
                        pa.array(found),
                        pa.array(scores),
                    ],
                    names=["query_id", "version", "copies", "vec_id", "score"],
                )


def _searching(k: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, cell = None, Cell(k)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            edges = [0, *changes(table, ["cell", "asks", "dim"]).tolist(), table.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                part = table.slice(a, b - a)
                here = part.column("cell")[0].as_py()
                if here != number:
                    yield from cell.best()
                    number, cell = here, Cell(k)
                dim = part.column("dim")[0].as_py()
                vectors = part.column("vec").to_pylist()
                if part.column("asks")[0].as_py() == 0:
                    names = (part.column(c).to_pylist() for c in ("vec_id", "version", "copies"))
                    cell.ask(dim, list(zip(*names, vectors, strict=True)))
                else:
                    cell.offer(dim, part.column("vec_id").to_numpy(), vectors)
        yield from cell.best()

    return search


def nearest(vectors: DataFrame, asks: Column, k: int = 20, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``vectors(vec_id, embedding, ...)`` for each row that ``asks``.

    Components count as ``floor(scale * x)``, scores are their inner products, ties go
    to the smaller id. Rows with the query's own id are never its candidates. A null
    vector, one with a null or non-finite component (or one that ``scale`` makes so) and a row without an id take no
    part; vectors of different lengths do not meet, empty ones score 0. Repeated rows are
    candidates each, and queries each; a query id with two vectors has a list for either. A
    query with fewer candidates than ``k`` gets all of them, with none no row. Other
    columns are ignored unless ``asks`` reads them; an empty table gives an empty result.

    A query block meets all candidates in as many tasks as there are shards, so what is
    shuffled is the candidates once per block of 16,384 queries, the queries once per shard.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.coalesce(asks, F.lit(False)).alias("query"),
    )
    kind = "vec_id long, dim int, mass double, vec binary, deal long"
    either = [
        rows.where(where).select("vec_id", "embedding").mapInArrow(_quantising(scale), kind).withColumn("query", F.lit(asked))
        for where, asked in ((F.col("query"), True), (~F.col("query"), False))
    ]
    found = written(either[0].unionByName(either[1]), "vectors")
    size = found.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("query").alias("asked"),
        F.coalesce(F.sum(F.when(F.col("query"), F.octet_length("vec"))), F.lit(0)).alias("asked_bytes"),
    ).first()
    blocks = max(1, -(-size["asked"] // QUERIES), -(-size["asked_bytes"] // QUERY_BYTES))
    wanted = max(1, -(-partitions(spark) // blocks))
    shards = max(1, -(-size["n"] // MOST_SHARD), min(wanted, -(-size["n"] // LEAST_SHARD)))
    block = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks))
    shard = F.pmod(F.xxhash64("deal", F.col("vec_id") % 1024), F.lit(shards))
    asked = (
        found.where("query")
        .groupBy("vec_id", "dim", "vec")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select(
            F.explode(F.sequence(block * shards, block * shards + (shards - 1))).alias("cell"),
            F.lit(0).alias("asks"), "dim", F.lit(0.0).alias("mass"), "vec", "vec_id",
            F.xxhash64("vec").alias("version"), "copies",
        )
    )
    offered = found.select(
        F.explode(F.sequence(shard, shard + (blocks - 1) * shards, F.lit(shards).cast("long"))).alias("cell"),
        F.lit(1).alias("asks"), "dim", "mass", "vec", "vec_id",
        F.lit(0).cast("long").alias("version"), F.lit(0).cast("long").alias("copies"),
    )
    cells = min(blocks * shards, 10_000)
    partial = (
        asked.unionByName(offered)
        .repartitionById(cells, F.pmod("cell", F.lit(cells)).cast("int"))
        .sortWithinPartitions("cell", "asks", "dim", F.desc("mass"), "vec", "vec_id")
        .mapInArrow(_searching(k), "query_id long, version long, copies long, vec_id long, score long")
    )
    by_query = Window.partitionBy("query_id", "version").orderBy(F.desc("score"), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(by_query))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
        .drop("copy")
    )
