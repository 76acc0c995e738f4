"""Quality scores from supervised subword embeddings.

A document is a bag of hashed features: its words, its character n-grams, and
the marks that a word stood one to three words before. Each feature has a learned
vector; a document is the mean of its vectors, and a softmax layer turns that
into the probability of a good text. Vectors and layer are trained by stochastic
gradient descent in numpy, in one task, on a bounded sample of labelled documents.

Scoring needs no vectors: the layer is linear, so each feature's part of the
logit is one number, and a document's logit is the mean of its features' numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import (
    buffer_of,
    held_out,
    labelled_sample,
    per_text,
    small_batches,
    text_of,
)
from postroom.llm.encoding import byte_batches

# Learning is bounded to this many labelled documents.
SAMPLE = 3_000
BITS = 18
BUCKETS = 1 << BITS
GRAMS = (3, 4)
BACK = (1, 2, 3)
DIMENSIONS = 8
EPOCHS = 3
RATE = 0.5
SEED = 42
# Texts are hashed in runs of about this many bytes.
RUN_BYTES = 2 * 1024 * 1024

# Odd multipliers of the hash, one per place in an n-gram.
_MULTIPLIERS = np.array(
    [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32
)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h >>= np.uint32(32 - BITS)
    return h


def features(buffer: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, bounds) per kind of feature; ``BUCKETS`` is no feature.

    ``bounds`` part the buckets by text as the given ones part the bytes.
    """
    size = len(buffer)
    wide = buffer.astype(np.uint32)
    starts, ends = bounds[:-1], bounds[1:]
    for n in GRAMS:
        if size < n:
            continue
        h = np.full(size - n + 1, n, np.uint32)
        for j in range(n):
            h += wide[j : size - n + 1 + j] * _MULTIPLIERS[j]
        h = _mixed(h)
        for back in range(1, n):
            crossing = ends - back
            crossing = crossing[(crossing >= starts) & (crossing < len(h))]
            h[crossing] = BUCKETS
        yield h, np.minimum(bounds, len(h))
    if not size:
        return
    inside = wide > 32
    edge = np.zeros(size, bool)
    edge[starts[starts < size]] = True
    first = np.flatnonzero(inside & (edge | ~np.concatenate([[False], inside[:-1]])))
    edge = np.zeros(size, bool)
    edge[(ends - 1)[ends > starts]] = True
    last = np.flatnonzero(inside & (edge | ~np.concatenate([inside[1:], [False]])))
    # A word's hash adds up its pairs of bytes, its ends and its length.
    pairs = wide * _MULTIPLIERS[0]
    pairs[:-1] += wide[1:] * _MULTIPLIERS[1]
    pairs ^= pairs >> np.uint32(11)
    pairs *= _MULTIPLIERS[2]
    sums = np.concatenate([[0], np.cumsum(pairs, dtype=np.uint32)]).astype(np.uint32)
    words = sums[last] - sums[first]
    words += wide[first] * _MULTIPLIERS[3] + wide[last] * _MULTIPLIERS[4]
    words += (last - first).astype(np.uint32)
    places = np.searchsorted(first, bounds)
    for back in BACK:
        same = np.full(len(words), BUCKETS, np.uint32)
        if len(words) > back:
            repeated = np.flatnonzero(words[back:] == words[:-back]) + back
            owner = np.searchsorted(places, repeated, "right") - 1
            repeated = repeated[repeated - back >= places[owner]]
            same[repeated] = _mixed(np.full(1, back, np.uint32))[0]
        yield same, places
    yield _mixed(words), places


def _bag(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of one text."""
    found = [b for b, _ in features(text, np.array([0, len(text)]))] or [np.zeros(0, np.uint32)]
    buckets, counts = np.unique(np.concatenate(found), return_counts=True)
    real = buckets < BUCKETS
    buckets, counts = buckets[real], counts[real]
    return buckets, (counts / max(1, counts.sum())).astype(np.float32)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buffer, bounds = buffer_of(batch.column("text"))
        bags = [_bag(buffer[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("label"),
                pa.array([b.tobytes() for b, _ in bags], pa.binary()),
                pa.array([s.tobytes() for _, s in bags], pa.binary()),
            ],
            names=["doc_id", "label", "buckets", "shares"],
        )


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: each bucket's part of the logit, and the prior for texts without features."""
    rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    rows.sort(key=lambda row: row[0])
    bags = [
        (np.frombuffer(b, np.uint32), np.frombuffer(s, np.float32), int(label))
        for _, label, b, s in rows
    ]
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((DIMENSIONS, 2), np.float32)
    steps, step = max(1, EPOCHS * len(bags)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            buckets, shares, label = bags[i]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            if not len(buckets):
                continue
            mean = shares @ vectors[buckets]
            logits = mean @ layer
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[label] -= 1
            back = layer @ chance
            layer -= rate * np.outer(mean, chance)
            # A mean over n features makes each one's gradient n times smaller; the
            # step makes up for the root of that.
            vectors[buckets] -= rate * np.float32(len(buckets) ** 0.5) * np.outer(shares, back)
    parts = vectors @ (layer[:, 1] - layer[:, 0])
    ones = sum(label for _, _, label in bags)
    prior = np.log((ones + 1) / (len(bags) - ones + 1))
    yield pa.RecordBatch.from_arrays(
        [pa.array([parts.astype(np.float32).tobytes()], pa.binary()), pa.array([float(prior)])],
        names=["parts", "prior"],
    )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """(each bucket's part of the logit, logit of a text without features).

    Learns from at most ``sample`` documents with a label outside the held-out
    fold. Without any, every text gets one half.
    """
    small_batches(docs.sparkSession)
    bags = labelled_sample(docs, labels, "quality", sample).mapInArrow(
        _bags, "doc_id long, label int, buckets binary, shares binary"
    )
    # At most ``sample`` bags, of at most BUCKETS entries each.
    row = bags.repartition(1).mapInArrow(_fit, "parts binary, prior double").first()
    if row is None:
        return np.zeros(BUCKETS + 1, np.float32), 0.0
    return np.append(np.frombuffer(row["parts"], np.float32), np.float32(0)), row["prior"]


def logits(parts: np.ndarray, prior: float, buffer: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(bounds) - 1)
    counted = np.zeros(len(bounds) - 1)
    for buckets, within in features(buffer, bounds):
        total += per_text(parts[buckets], within)
        counted += per_text(buckets < BUCKETS, within)
    return np.where(counted > 0, total / np.maximum(counted, 1), prior)


def _scoring(parts: np.ndarray, prior: float) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in byte_batches(batches, "text", RUN_BYTES):
            buffer, bounds = buffer_of(rows.column("text"))
            if len(buffer) > 2 * RUN_BYTES:
                value = [long_logit(parts, prior, buffer)]
            else:
                value = logits(parts, prior, buffer, bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").combine_chunks(),
                    pa.array(1 / (1 + np.exp(-np.asarray(value, float)))),
                ],
                names=["doc_id", "score"],
            )

    return score


def _word_start(buffer: np.ndarray, at: int, step: int = 1 << 16) -> int:
    """Where the first word begins that stands behind white space from ``at`` on; else the end."""
    for low in range(at, len(buffer), step):
        white = buffer[low - 1 : low + step] <= 32
        found = np.flatnonzero(white[:-1] & ~white[1:])
        if len(found):
            return low + int(found[0])
    return len(buffer)


def long_logit(parts: np.ndarray, prior: float, buffer: np.ndarray, run_bytes: int = RUN_BYTES) -> float:
    """The logit of a very long text, taken run by run; the features are those of the whole text.

    Runs begin at words. Of each run, n-grams count that begin in it, with the bytes behind it, and
    words, with those before it that may have been the same.
    """
    total = counted = 0.0
    at = before = known = 0
    words = len(BACK) + 1
    while at < len(buffer):
        end = _word_start(buffer, at + run_bytes)
        ahead, behind = buffer[at : end + max(GRAMS) - 1], buffer[before:end]
        grams = [b[: end - at] for b, _ in list(features(ahead, np.array([0, len(ahead)])))[:-words]]
        others = [b[known:] for b, _ in list(features(behind, np.array([0, len(behind)])))[-words:]]
        for buckets in grams + others:
            total += float(parts[buckets].sum(dtype=np.float64))
            counted += int((buckets < BUCKETS).sum())
        inside = behind > 32
        first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))[-max(BACK) :]
        before, known = (before + int(first[0]), len(first)) if len(first) else (end, 0)
        at = end
    return total / counted if counted else prior


def quality_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text, ...)``.

    ``score`` is the chance that ``labels.quality`` is 1, from the text alone.
    A null or empty text scores the share of good documents in the sample. A row
    without an id counts as held out; repeated rows score alike; labels without a
    document, null labels and repeated ones (the largest counts) do no harm; other
    columns are ignored; an empty table gives an empty result. Scoring shuffles
    nothing.
    """
    parts, prior = fit(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    scored = rows.mapInArrow(_scoring(parts, prior), "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
