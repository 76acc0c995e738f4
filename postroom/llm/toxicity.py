"""Toxicity of texts whose spelling may be disguised.

Writing is seen as a noisy channel: letters come out as look-alike signs, words
are spaced out, letters are repeated. Where a text shows such signs, the symbols
span a lattice of what may have been meant, and Viterbi decoding picks the path a
character model of the whole corpus likes best. The restored text is then scored:
character n-grams of words weigh as much as they mark toxic labelled documents,
by how many of them hold one and by how dense it stands there, and a logistic layer
judges a document by its strongest words and by how thickly they stand.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import (
    buffer_of,
    held_out,
    labelled_sample,
    small_batches,
    text_of,
)
from postroom.llm.encoding import byte_batches

# Learning of labels is bounded to this many documents; the character model reads all.
SAMPLE = 8_000
RUN_BYTES = 4 * 1024 * 1024
BITS = 20
GRAMS = (3, 4, 5, 6, 8)
LEAST_DOCUMENTS = 4
# Parts of the sample, each judged by weights learnt from the others.
PARTS = 4
TOP = 3
# A density per word that is added to both sides of a ratio, and how sure the ratio must be.
BACKGROUND, SURE = 2e-5, 4.0
# Weights by density that words are counted above, and the share of a text's words that counts in full.
DENSE, FULL = (2.0, 2.5, 3.0, 3.5), 0.02
# What a text shows: its strongest words, how many speak, and shares of dense ones.
SHOWN = TOP + 1 + len(DENSE)

# What each sign may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
}
SEPARATORS = " .-_*"
# Costs of the channel, as negative logarithms.
SWAPPED, KEPT, DROPPED, SHORTENED = 1.0, 9.0, 0.5, 0.5

SYMBOLS = 64
EDGE = 0


def _symbol_table() -> np.ndarray:
    """Letters are 1 to 26 whatever their case, other ASCII bytes are an edge, the rest share 37."""
    table = np.zeros(256, np.uint8)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = i + 1
    high = np.arange(128, 256)
    table[high] = 27 + (high & 63) % 37
    return table


_SYMBOL = _symbol_table()
_LETTER = (_SYMBOL >= 1) & (_SYMBOL <= 26)
_HIGH = np.arange(256) >= 128
_ALNUM = _LETTER | np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8)) | _HIGH
_SIGN = np.isin(np.arange(256), np.frombuffer("".join(LOOK_ALIKES).encode("ascii", "ignore"), np.uint8))
_SEPARATOR = np.isin(np.arange(256), np.frombuffer(SEPARATORS.encode(), np.uint8))
# Signs that stand after a letter for no other reason, unlike digits and "!".
_STRONG = np.isin(np.arange(256), np.frombuffer(b"@$|+", np.uint8))
_WORDLY = _LETTER | np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8))
_EURO = "€".encode()
# Separators between two spaced-out letters, at most.
MOST_GAPS = 3


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Character trigrams of a task's texts, added up in one array of fixed size."""
    counts = np.zeros(SYMBOLS**3, np.int64)
    for rows in byte_batches(batches, "text", RUN_BYTES):
        buffer, bounds = buffer_of(rows.column("text"))
        # Two edges part one text from the next.
        spread = np.full(len(buffer) + 2 * len(bounds), EDGE, np.int32)
        spread[np.arange(len(buffer)) + 2 * np.repeat(np.arange(1, len(bounds)), np.diff(bounds))] = _SYMBOL[buffer]
        grams = (spread[:-2] * SYMBOLS + spread[1:-1]) * SYMBOLS + spread[2:]
        counts += np.bincount(grams, minlength=SYMBOLS**3)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=["gram", "n"]
    )


def character_model(docs: DataFrame) -> np.ndarray:
    """Costs of a symbol after two others, from every text of ``docs(text, ...)``.

    What reaches the driver is one number per trigram of 64 symbols, whatever the corpus holds.
    """
    small_batches(docs.sparkSession)
    counted = (
        docs.select(text_of().alias("text"))
        .mapInArrow(_counting, "gram int, n long")
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
    )
    counts = np.zeros(SYMBOLS**3)
    found = counted.toArrow()
    counts[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS) + 0.02
    return -np.log(cube / cube.sum(axis=2, keepdims=True)).astype(np.float32)


def _lattice(segment: str) -> list[list[tuple[str, float]]]:
    """Per symbol of the segment: (what it may stand for, cost); "" is nothing at all."""
    steps: list[list[tuple[str, float]]] = []
    spaced = len(re.findall(r"(?<![^\W_])[^\W_](?![^\W_])", segment)) >= 3
    lowered, i = segment.lower(), 0
    while i < len(lowered):
        sign = lowered[i]
        run = len(lowered[i:]) - len(lowered[i:].lstrip(sign))
        if sign in LOOK_ALIKES:
            options = [(letter, SWAPPED) for letter in LOOK_ALIKES[sign]] + [(" ", KEPT)]
            steps.extend([options] * run)
        elif sign in SEPARATORS and spaced:
            steps.append([("", DROPPED), (" ", DROPPED + 2 * (run == 1))])
        elif sign.isalpha() and run >= 3:
            steps.append([(sign, 0.0)])
            steps.append([("", SHORTENED), (sign, SHORTENED)])
        elif sign.isalpha():
            steps.extend([[(sign, 0.0)]] * run)
        else:
            steps.append([(" ", 0.0)])
        i += run
    return steps


def _code(letter: str) -> int:
    return int(_SYMBOL[letter.encode()[-1]])


def decode(segment: str, model: np.ndarray) -> str:
    """The likeliest original of a disguised passage under the channel and the model.

    Its time is linear in the passage: a state is the last two symbols.
    """
    states: dict[tuple[int, int], tuple[float, tuple]] = {(EDGE, EDGE): (0.0, ())}
    for options in [*_lattice(segment), [(" ", 0.0)]]:
        following: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, path) in states.items():
            for letter, extra in options:
                if letter:
                    c = _code(letter)
                    state, total, way = (b, c), cost + extra + float(model[a, b, c]), (path, letter)
                else:
                    state, total, way = (a, b), cost + extra, path
                if state not in following or total < following[state][0]:
                    following[state] = (total, way)
        states = following
    _, path = min(states.values(), key=lambda s: s[0])
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters)).strip()


def disguised(buffer: np.ndarray) -> np.ndarray:
    """Places where spelling looks disguised: a sign before a letter, or one that ends no
    sentence after a letter or digit, a letter three times, or single characters with separators between them."""
    size = len(buffer)
    marks = np.zeros(size, bool)
    if size < 3:
        return marks
    letter, sign = _LETTER[buffer], _SIGN[buffer]
    marks[:-1] |= sign[:-1] & letter[1:]
    marks[:-1] |= _WORDLY[buffer[:-1]] & _STRONG[buffer[1:]]
    euro = (buffer[:-2] == _EURO[0]) & (buffer[1:-1] == _EURO[1]) & (buffer[2:] == _EURO[2])
    for at in np.flatnonzero(euro):
        marks[at] = (at > 0 and letter[at - 1]) or (at + 3 < size and letter[at + 3])
    same = (buffer[1:] | 32) == (buffer[:-1] | 32)
    marks[:-2] |= same[:-1] & same[1:] & letter[:-2]
    alnum, gaps = _ALNUM[buffer], np.concatenate([[0], np.cumsum(_SEPARATOR[buffer])])
    alone = np.flatnonzero(alnum & ~np.concatenate([[False], alnum[:-1]]) & ~np.concatenate([alnum[1:], [False]]))
    apart = np.diff(alone)
    near = (apart <= 1 + MOST_GAPS) & (gaps[alone[1:]] - gaps[alone[:-1]] == apart - 1)
    marks[alone[:-2][near[:-1] & near[1:]]] = True
    return marks


_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*]{1,3}[^\W_](?![^\W_])){2,}")
_ODD = re.compile(r"[0-9@$!|+€](?=[^\W\d_])|(?<=[^\W_])!*[@$|+€]|([a-z])\1\1", re.IGNORECASE)


def restorer(model: np.ndarray) -> Callable[[str], str]:
    """A function from a text to the text with disguised passages decoded."""
    decoded = lru_cache(maxsize=50_000)(lambda segment: decode(segment, model))

    def mend(word: str) -> str:
        body = word.rstrip('.,;:?!"\')')
        return decoded(body.lower()) + word[len(body) :]

    def restore(text: str) -> str:
        text = _SPACED.sub(lambda found: decoded(found.group().lower()), text)
        return " ".join([mend(word) if _ODD.search(word) else word for word in text.split(" ")])

    return restore


def _restored(texts: pa.Array, restore: Callable[[str], str]) -> pa.Array:
    buffer, bounds = buffer_of(texts)
    marks = np.concatenate([[0], np.cumsum(disguised(buffer))])
    odd = np.flatnonzero(marks[bounds[1:]] > marks[bounds[:-1]])
    if not len(odd):
        return texts
    mended = pa.array([restore(texts[i].as_py()) for i in odd], texts.type)
    mask = np.zeros(len(texts), bool)
    mask[odd] = True
    return pc.replace_with_mask(texts, pa.array(mask), mended)


_EDGES = " \t\n\r.,;:!?\"'()[]{}<>|%$&*#=-_/"


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text of each word, code of each word, distinct words), lower-cased, without outer marks."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    coded = split.flatten().dictionary_encode()
    cores = pc.utf8_trim(coded.dictionary, _EDGES).dictionary_encode()
    codes = cores.indices.to_numpy()[coded.indices.to_numpy()] if len(cores) else np.zeros(0, np.int32)
    return np.repeat(np.arange(len(texts)), counts), codes, cores.dictionary


def word_grams(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, word) of every character n-gram of "<word>", and of whole words."""
    buffer, bounds = buffer_of(words)
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(words)), size + 2)
    spread = np.zeros(len(buffer) + 2 * len(words), np.uint64)
    starts = bounds[:-1] + 2 * np.arange(len(words))
    spread[starts], spread[starts + size + 1] = ord("<"), ord(">")
    spread[np.arange(len(buffer)) + np.repeat(2 * np.arange(len(words)) + 1, size)] = buffer
    h = spread.copy()
    for n in range(2, max(GRAMS) + 1):
        if len(spread) < n:
            return
        h = h[: len(spread) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + spread[n - 1 :]
        h ^= h >> np.uint64(29)
        if n in GRAMS:
            within = owner[n - 1 :] == owner[: len(h)]
            mixed = (h[within] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
            yield mixed.astype(np.int64), owner[: len(h)][within]


def word_weights(words: pa.Array, *tables: np.ndarray) -> list[np.ndarray]:
    """Per table the largest weight among each word's n-grams; 0 when none speaks for toxicity."""
    best = [np.zeros(len(words), np.float32) for _ in tables]
    for bucket, owner in word_grams(words):
        for found, weights in zip(best, tables, strict=True):
            value = weights[bucket]
            hits = np.flatnonzero(value > 0)
            np.maximum.at(found, owner[hits], value[hits])
    return best


def _evidence(
    owner: np.ndarray, codes: np.ndarray, best: np.ndarray, dense: np.ndarray, texts: int, times: np.ndarray | None = None
) -> np.ndarray:
    """Per text: its strongest words' weights, how many words speak at all, and the shares of all
    occurrences (``times`` of each word) whose weight by density is above some levels."""
    out = np.zeros((texts, SHOWN))
    hits = np.flatnonzero(best[codes] > 0)
    pairs = np.unique(owner[hits].astype(np.int64) * len(best) + codes[hits])
    text, value = pairs // max(1, len(best)), best[pairs % max(1, len(best))]
    order = np.lexsort((-value, text))
    text, value = text[order], value[order]
    rank = np.arange(len(text)) - np.searchsorted(text, text)
    top = rank < TOP
    out[text[top], rank[top]] = value[top]
    out[:, TOP] = np.log1p(np.bincount(text, minlength=texts))
    times = np.ones(len(codes)) if times is None else times
    size = np.maximum(np.bincount(owner, times, texts), 1)
    weight = dense[codes]
    for at, least in enumerate(DENSE):
        share = np.bincount(owner, times * (weight > least), texts) / size
        out[:, TOP + 1 + at] = np.minimum(share / FULL, 1)
    return out


def _vocabularies(model: np.ndarray) -> Callable:
    """(doc_id, label, words, times): the distinct words of each restored text, and how often each stands there."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = restorer(model)
        for batch in batches:
            owner, codes, words = _words(_restored(batch.column("text"), restore))
            rows = np.split(codes, np.searchsorted(owner, np.arange(1, batch.num_rows)))
            counted = [np.unique(r, return_counts=True) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("label"),
                    pa.array([words.take(pa.array(c)).to_pylist() for c, _ in counted], pa.list_(pa.string())),
                    pa.array([n.tolist() for _, n in counted], pa.list_(pa.int64())),
                ],
                names=["doc_id", "label", "words", "times"],
            )

    return distinct


def _gram_weights(counts: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """How much more often than others toxic documents hold each n-gram, as a logarithm; 0 if not."""
    toxic = np.log((counts[1] + 0.5) / (documents[1] + 1))
    clean = np.log((counts[0] + 2.0) / (documents[0] + 4))
    return np.where(counts[1] >= LEAST_DOCUMENTS, np.maximum(toxic - clean, 0), 0).astype(np.float32)


def _gram_densities(shares: np.ndarray, counts: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """How much denser than elsewhere each n-gram stands in toxic documents, as a logarithm; 0 if that may be chance.

    ``shares`` are sums over documents of the n-gram's occurrences per word, so that no
    long text outweighs the others. Of a million n-grams many differ by chance, so
    the logarithm must be ``SURE`` times its error, as the numbers of documents that hold the n-gram give it.
    """
    toxic = shares[1] / (documents[1] + 1) + BACKGROUND
    clean = shares[0] / (documents[0] + 1) + BACKGROUND
    ratio = np.log(toxic / clean)
    error = np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 2.0))
    sure = (counts[1] >= LEAST_DOCUMENTS) & (ratio > SURE * error)
    return np.where(sure, ratio, 0).astype(np.float32)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Logistic regression, the first column constant, by Newton steps that never lose.

    Columns are scaled; the penalty keeps the layer finite where the classes part cleanly,
    and a step is halved until the penalised loss goes down.
    """
    scale = np.maximum(np.abs(x).max(axis=0, initial=0), 1e-9)
    z = x / scale
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3

    def loss(v: np.ndarray) -> float:
        score = z @ v
        return float(np.sum(np.logaddexp(0, score) - y * score) + 0.5 * np.sum(penalty * v * v))

    layer = np.zeros(x.shape[1])
    now = loss(layer)
    for _ in range(50):
        chance = 0.5 * (1 + np.tanh(0.5 * (z @ layer)))
        slope = z.T @ (chance - y) + penalty * layer
        curve = (z.T * (chance * (1 - chance))) @ z + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        while loss(layer - step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        layer = layer - step
        before, now = now, loss(layer)
        if before - now < 1e-9 * max(1.0, abs(before)):
            break
    return layer / scale


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: n-gram weights from the sample, and the logistic layer over their evidence.

    The layer sees each document as weights learnt from the other parts see it.
    """
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    rows.sort(key=lambda row: (row[0] * 2654435761 % 2**32, row[0]))
    counts = np.zeros((PARTS, 2, 1 << BITS), np.int32)
    shares = np.zeros((PARTS, 2, 1 << BITS), np.float32)
    documents = np.zeros((PARTS, 2), np.int64)
    for i, (_, label, words, times) in enumerate(rows):
        documents[i % PARTS, int(label)] += 1
        share = np.array(times, np.float32) / max(1, sum(times))
        grams = list(word_grams(pa.array(words, pa.string())))
        if grams:
            counts[i % PARTS, int(label), np.unique(np.concatenate([bucket for bucket, _ in grams]))] += 1
        for bucket, owner in grams:
            np.add.at(shares[i % PARTS, int(label)], bucket, share[owner])
    every, dense, all_documents = counts.sum(axis=0), shares.sum(axis=0), documents.sum(axis=0)
    x, y = np.zeros((len(rows), SHOWN + 1)), np.zeros(len(rows))
    for part in range(PARTS):
        others, left = every - counts[part], all_documents - documents[part]
        tables = _gram_weights(others, left), _gram_densities(dense - shares[part], others, left)
        for i in range(part, len(rows), PARTS):
            _, y[i], words, times = rows[i]
            best = word_weights(pa.array(words, pa.string()), *tables)
            owner, codes = np.zeros(len(words), np.int64), np.arange(len(words))
            x[i] = [1, *_evidence(owner, codes, *best, 1, np.array(times, np.float64))[0]]
    tables = _gram_weights(every, all_documents), _gram_densities(dense, every, all_documents)
    layer = _logistic(x, y)
    yield pa.RecordBatch.from_arrays(
        [*(pa.array([t.tobytes()], pa.binary()) for t in tables), pa.array([layer.tolist()])],
        names=["weights", "densities", "layer"],
    )


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, sample: int = SAMPLE) -> tuple[np.ndarray, ...]:
    """(n-gram weights, n-gram densities, logistic layer) from at most ``sample`` labelled documents."""
    words = labelled_sample(docs, labels, "toxic", sample).mapInArrow(
        _vocabularies(model), "doc_id long, label int, words array<string>, times array<long>"
    )
    row = words.repartition(1).mapInArrow(_fit, "weights binary, densities binary, layer array<double>").first()
    if row is None:
        return np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), np.zeros(SHOWN + 1)
    return np.frombuffer(row["weights"], np.float32), np.frombuffer(row["densities"], np.float32), np.array(row["layer"])


def _scores(
    model: np.ndarray, weights: np.ndarray, densities: np.ndarray, layer: np.ndarray
) -> Callable[[pa.Table], np.ndarray]:
    restore = restorer(model)

    def score(rows: pa.Table) -> np.ndarray:
        column = pc.fill_null(rows.column("text").combine_chunks(), "")
        texts = _restored(column, restore)
        owner, codes, words = _words(texts)
        seen = _evidence(owner, codes, *word_weights(words, weights, densities), len(texts))
        return 0.5 * (1 + np.tanh(0.5 * (layer[0] + seen @ layer[1:])))

    return score


def _scoring(*learnt: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scores(*learnt)
        for rows in byte_batches(batches, "text", RUN_BYTES):
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").combine_chunks(), pa.array(score(rows))], names=["doc_id", "score"]
            )

    return run


def _keeping(learnt: tuple[np.ndarray, ...], threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scores(*learnt)
        for rows in byte_batches(batches, "text", RUN_BYTES):
            yield from rows.filter(pa.array(score(rows) < threshold)).combine_chunks().to_batches()

    return run


def _learnt(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, ...]:
    model = character_model(docs)
    return (model, *fit(docs, labels, model, sample))


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text, ...)``.

    ``score`` is the chance that ``labels.toxic`` is 1, from the restored text alone.
    A null or empty text scores as one without any toxic word. A row without an id
    counts as held out; repeated rows score alike; labels without a document, null
    labels and repeated ones (the largest counts) do no harm; other columns are
    ignored; an empty table gives an empty result. Scoring shuffles nothing.
    """
    learnt = _learnt(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    scored = rows.mapInArrow(_scoring(*learnt), "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE
) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with all of their columns."""
    return docs.mapInArrow(_keeping(_learnt(docs, labels, sample), threshold), docs.schema)
