"""Repeated passages by column-wise construction of a multi-document BWT.

Every string of 100 bytes is tied to an anchor, the 24 bytes within it whose hash is
smallest, so equal strings share their anchor. Strings of one anchor that follow each
other are a context of at most 176 bytes. Contexts are compared as follows:

1. Anchors with equal contexts meet in a shuffle of hashes alone. All but the first
   context in document order are repeats; an anchor met once needs no more work.
2. Different contexts of one anchor may still share strings of 100 bytes. They are cut
   from the texts and brought together, and blocks of them are put into one
   collection: a round inserts one more symbol of every context, from its end to its
   start, and updates the Burrows-Wheeler transform and the longest common prefixes.
   Neighbours with 100 bytes in common in the final order are repeats. A context whose
   38 bytes before the anchor and whose 38 bytes behind it no other one shares has no
   string in common with any, and stays out.
3. What repeats is removed from the texts.

An anchor of many contexts is no key for a task. Its strings are parted by where the
anchor stands in them, and each part is keyed by the bytes that all its strings hold:
91 and more in eight parts, and with still more contexts each string is its own key, so
that only equal strings meet, by 128 bits of hashes. Equal parts are settled before the
shuffle, once for every few thousand contexts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postroom.llm.common import (
    buffer_of,
    changes,
    partitions,
    small_batches,
    text_of,
    whole_runs,
    written,
)
from postroom.llm.encoding import byte_batches

LENGTH = 100
ANCHOR = 24
# Window starts hashed at a time; a place among them takes the low bits of a hash.
RUN_BITS = 20
RUN = (1 << RUN_BITS) - 4 * LENGTH
TASK_BYTES = 16 * 1024 * 1024
# Contexts in one collection, and those that are cut from texts at a time.
BLOCK = 4_096
# Different contexts from which an anchor's strings are keyed in eight parts, and one by one.
HOT, HOTTER = 1_024, 65_536
PARTS, STRINGS = 8, LENGTH - ANCHOR + 1
# Rows of one anchor that are looked at together.
TOGETHER = 1 << 18
# Of the bytes around an anchor a string holds so many on one side at least.
SIDE = (LENGTH - ANCHOR) // 2

_M1, _M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _powers(base: int, count: int) -> np.ndarray:
    powers = np.full(count, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


_UP = _powers(_M2, (1 << RUN_BITS) + 1)
_DOWN = _powers(pow(_M2, -1, 1 << 64), (1 << RUN_BITS) + 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


# Other values of the bytes, for hashes that do not depend on the first ones.
_VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_M1))


def _window_hashes(run: np.ndarray) -> np.ndarray:
    """Hash of the ``ANCHOR`` bytes from each place on, by doubling: 1, 2, 4, 8, 16, 24."""
    base = lambda n: np.uint64(pow(_M1, n, 1 << 64))
    h = run.astype(np.uint64) + np.uint64(1)
    for n in (1, 2, 4):
        h = h[:-n] * base(n) + h[n:]
    eight = h
    sixteen = h[:-8] * base(8) + h[8:]
    size = len(run) - ANCHOR + 1
    return _mixed(sixteen[:size] * base(8) + eight[16 : 16 + size])


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    step = 1
    size = len(v) - width + 1
    least = v
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    return np.minimum(least[:size], least[width - step : width - step + size])


def contexts(buffer: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, context hash, text, start in text, strings) of every context.

    A context is ``strings`` + 99 bytes from its start. Strings never cross texts.
    """
    width = LENGTH - ANCHOR + 1
    for at in range(0, max(0, len(buffer) - LENGTH + 1), RUN):
        run = buffer[at : at + RUN + LENGTH - 1]
        hashes = _window_hashes(run)
        mask = np.uint64((1 << RUN_BITS) - 1)
        placed = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
        place = (_sliding_least(placed, width) & mask).astype(np.int64)
        starts = np.arange(at, at + len(place))
        text = np.searchsorted(bounds, starts, "right") - 1
        valid = starts + LENGTH <= bounds[text + 1]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place))
        kept = valid[first]
        first, last = first[kept], last[kept]
        sums = np.zeros(len(run) + 1, np.uint64)
        np.cumsum((run.astype(np.uint64) + np.uint64(1)) * _UP[: len(run)], out=sums[1:])
        inner = _mixed((sums[last + LENGTH - 1] - sums[first]) * _DOWN[first] + (last - first).astype(np.uint64))
        yield hashes[place[first]], inner, text[first], first + at - bounds[text[first]], last - first


def _merged(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unite intervals of one owner that overlap or touch."""
    if not len(owner):
        return owner, start, stop
    order = np.lexsort((start, owner))
    owner, start, stop = owner[order], start[order], stop[order]
    # Owners are laid one after the other, so that one running maximum serves all.
    span = int(stop.max()) + 2
    reach = np.maximum.accumulate(owner * span + stop)
    new = np.concatenate([[True], owner[1:] * span + start[1:] > reach[:-1]])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(owner)) - 1
    return owner[begin], start[begin], reach[end] - owner[begin] * span


_ROW = "key long, inner long, doc_id long, version long, start long, strings long"


def _finding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First contexts of a task's texts; ``strings`` under 0 is an interval known to repeat."""
    for rows in byte_batches(batches, "text", TASK_BYTES):
        buffer, bounds = buffer_of(rows.column("text"))
        parts = list(contexts(buffer, bounds))
        if not parts:
            continue
        key, inner, text, start, strings = map(np.concatenate, zip(*parts, strict=True))
        doc_id = rows.column("doc_id").to_numpy()
        version = rows.column("version").to_numpy()
        order = np.empty(len(doc_id), np.int64)
        order[np.lexsort((version, doc_id))] = np.arange(len(doc_id))
        by = np.lexsort((start, order[text], inner, key))
        key, inner, text, start, strings = (a[by] for a in (key, inner, text, start, strings))
        again = np.concatenate([[False], (key[1:] == key[:-1]) & (inner[1:] == inner[:-1])])
        # A repeated row is no repeat of itself here; rows are told apart in the end.
        group = np.cumsum(~again) - 1
        head = np.flatnonzero(~again)[group]
        same = (doc_id[text] == doc_id[text[head]]) & (version[text] == version[text[head]]) & (start == start[head])
        later = again & ~same
        owner, a, b = _merged(text[later].astype(np.int64), start[later], (start + strings + LENGTH - 1)[later])
        yield _rows(key[~again], inner[~again], doc_id[text[~again]], version[text[~again]], start[~again], strings[~again])
        yield _rows(_mixed(version[owner].view(np.uint64)), np.zeros(len(owner)), doc_id[owner], version[owner], a, a - b)


def _rows(key, inner, doc_id, version, start, strings, parts=None) -> pa.RecordBatch:
    columns = [np.asarray(key).view(np.int64), np.asarray(inner).astype(np.uint64).view(np.int64), doc_id, version, start, strings]
    names = ["key", "inner", "doc_id", "version", "start", "strings"]
    if parts is not None:
        columns.append(np.broadcast_to(parts, len(doc_id)))
        names.append("parts")
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(np.int64)) for c in columns], names=names)


def _bounded_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, bool]]:
    """(rows, long) of a stream sorted by ``key``: whole runs, or a piece of one of over ``most`` rows."""
    running = None
    held: list[pa.RecordBatch] = []

    def split(last: bool) -> Iterator[tuple[pa.Table, bool]]:
        nonlocal running, held
        table = pa.Table.from_batches(held).combine_chunks()
        held = []
        edges = [0, *changes(table, ["key"]).tolist(), table.num_rows]
        begin, end = 0, edges[-1] if last else edges[-2]
        if running is not None:
            if table.column("key")[0].as_py() == running:
                yield table.slice(0, edges[1]), True
                begin = edges[1]
            if len(edges) > 2 or begin == 0:
                running = None
        elif len(edges) == 2 and not last:
            running = table.column("key")[0].as_py()
            yield table, True
            return
        if begin < end:
            yield table.slice(begin, end - begin), False
        if max(begin, end) < table.num_rows:
            held = table.slice(max(begin, end)).to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            yield from split(False)
    if held:
        yield from split(True)


def _meeting(
    batches: Iterator[pa.RecordBatch], hot: int, hotter: int, together: int
) -> Iterator[pa.RecordBatch]:
    """From sorted contexts: repeats as intervals, and first contexts of anchors with several.

    ``parts`` is in how many parts the strings of a context are keyed. Of an anchor with more
    rows than are looked at together, all are keyed one by one.
    """
    carried = None
    for table, long in _bounded_runs(batches, together):
        columns = [c.to_numpy() for c in table.columns]
        known = columns[5] < 0
        yield _rows(*(c[known] for c in columns), 0)
        columns = [c[~known] for c in columns]
        if not len(columns[0]):
            continue
        # The first context like the last one of the piece before.
        before = long and carried is not None and carried[0] == columns[0][0]
        if before:
            columns = [np.append(c, a).astype(np.int64) for c, a in zip(carried, columns, strict=True)]
        key, inner, doc_id, version, start, strings = columns
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        first = new_key | np.concatenate([[True], inner[1:] != inner[:-1]])
        group = np.cumsum(first) - 1
        head = np.flatnonzero(first)[group]
        carried = [c[head[-1] : head[-1] + 1] for c in columns] if long else None
        same = (doc_id == doc_id[head]) & (version == version[head]) & (start == start[head])
        later = ~first & ~same
        yield _rows(
            key[later], inner[later], doc_id[later], version[later], start[later], -(strings + LENGTH - 1)[later], 0
        )
        variants = np.bincount(np.cumsum(new_key) - 1, weights=first)[np.cumsum(new_key) - 1]
        parts = np.where(variants > hotter, STRINGS, np.where(variants > hot, PARTS, 1))
        if long:
            parts[:] = STRINGS
        several = first & ((variants > 1) | long)
        several[0] &= not before
        yield _rows(*(a[several] for a in (*columns, parts)))


_PIECE = "key long, doc_id long, version long, start long, size long, before long, behind long, context binary"


def _pieces(key, doc_id, version, start, size, before, behind, context) -> pa.RecordBatch:
    columns = [np.asarray(key).view(np.int64), doc_id, version, start, size]
    sides = [np.broadcast_to(np.asarray(c, np.uint64), len(doc_id)).view(np.int64) for c in (before, behind)]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(np.asarray(c)) for c in columns), *map(pa.array, sides), pa.array(context, pa.binary())],
        names=["key", "doc_id", "version", "start", "size", "before", "behind", "context"],
    )


def _anchor_places(run: np.ndarray, begin: np.ndarray, key: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Where in each context the anchor stands that all its strings hold."""
    hashes = _window_hashes(run)
    owner = np.repeat(np.arange(len(begin)), strings + LENGTH - 1)[: len(hashes)]
    place = np.arange(len(hashes)) - begin[owner]
    hit = np.flatnonzero((hashes == key[owner]) & (place >= strings[owner] - 1) & (place <= LENGTH - ANCHOR))
    _, first = np.unique(owner[hit], return_index=True)
    return place[hit[first]]


def _keyed(run, key, doc_id, version, start, strings, parts) -> Iterator[pa.RecordBatch]:
    """The parts of contexts laid one after the other in ``run``.

    A null context marks an interval that is known to repeat; one of eight bytes is a hash.
    """
    size = strings + LENGTH - 1
    begin = np.cumsum(size) - size
    anchor = _anchor_places(run, begin, key, strings)
    sums, other = np.zeros((2, len(run) + 1), np.uint64)
    np.cumsum((run.astype(np.uint64) + np.uint64(1)) * _UP[: len(run)], out=sums[1:])
    np.cumsum(_VALUES[run] * _UP[: len(run)], out=other[1:])

    def digest(low: np.ndarray, high: np.ndarray, of: np.ndarray = sums) -> np.ndarray:
        return _mixed((of[high] - of[low]) * _DOWN[low] + (high - low).astype(np.uint64))

    joined = run.tobytes()
    for k in np.unique(parts).tolist():
        # Bytes before the anchor within a string, from ``low`` to ``high`` in each part.
        edges = -(-np.arange(k + 1) * STRINGS // k)
        row = np.repeat(np.flatnonzero(parts == k), k)
        low, high = np.tile(edges[:-1], len(row) // k), np.tile(edges[1:] - 1, len(row) // k)
        first, last = np.maximum(anchor[row] - high, 0), np.minimum(anchor[row] - low, strings[row] - 1)
        held = first <= last
        row, low, high, first, last = (a[held] for a in (row, low, high, first, last))
        at = begin[row] + anchor[row]
        core = digest(at - low, at - high + LENGTH)
        a, b = begin[row] + first, begin[row] + last + LENGTH
        head = np.arange(len(row))
        if k > 1:
            content = digest(a, b, other)
            by = np.lexsort((start[row] + first, version[row], doc_id[row], content, core))
            row, first, a, b, core, content = (x[by] for x in (row, first, a, b, core, content))
            again = np.concatenate([[False], (core[1:] == core[:-1]) & (content[1:] == content[:-1])])
            head = np.flatnonzero(~again)
            to = head[np.cumsum(~again) - 1]
            same = (doc_id[row] == doc_id[row[to]]) & (version[row] == version[row[to]])
            same &= start[row] + first == start[row[to]] + first[to]
            later = again & ~same
            owner, low, high = _merged(row[later], (start[row] + first)[later], (start[row] + first + b - a)[later])
            yield _pieces(
                _mixed(version[owner].view(np.uint64)), doc_id[owner], version[owner], low, high - low, 0, 0,
                [None] * len(owner),
            )
            before, behind = np.ones((2, len(head)), np.uint64)
        else:
            before = np.where(anchor[row] >= SIDE, digest(np.maximum(at - SIDE, 0), at), np.uint64(0))
            end = np.minimum(at + ANCHOR + SIDE, len(run))
            behind = np.where(anchor[row] + ANCHOR + SIDE <= size[row], digest(at + ANCHOR, end), np.uint64(0))
        row, first, a, b, core = (x[head] for x in (row, first, a, b, core))
        if k == STRINGS:
            cut = [c.tobytes() for c in content[head]]
        else:
            cut = [joined[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        yield _pieces(core, doc_id[row], version[row], start[row] + first, b - a, before, behind, cut)


def _cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts asked for."""
    for batch in batches:
        asked = batch.column("asked")
        counts = np.diff(asked.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), counts)
        inner = asked.flatten()
        key, start, strings, parts = (inner.field(i).to_numpy() for i in range(4))
        doc_id, version = (batch.column(c).to_numpy()[row] for c in ("doc_id", "version"))
        buffer, bounds = buffer_of(batch.column("text"))
        for at in range(0, len(row), BLOCK):
            few = slice(at, at + BLOCK)
            size = strings[few] + LENGTH - 1
            begin = np.cumsum(size) - size
            run = buffer[np.repeat(bounds[row[few]] + start[few] - begin, size) + np.arange(int(size.sum()))]
            yield from _keyed(
                run, key[few].view(np.uint64), doc_id[few], version[few], start[few], strings[few], parts[few]
            )


def _grown(array: np.ndarray, old: np.ndarray, target: np.ndarray, new: np.ndarray | int) -> np.ndarray:
    grown = np.empty(len(old), array.dtype)
    grown[old] = array
    grown[target] = new
    return grown


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value after each low place up to the high one."""
    by = np.argsort(low)
    edges = np.empty(2 * len(by), np.int64)
    edges[0::2], edges[1::2] = low[by] + 1, high[by] + 1
    # In order of their low places the stretches between two ranges add up to one pass.
    found = np.empty(len(by), values.dtype)
    found[by] = np.minimum.reduceat(np.append(values, values.dtype.type(255)), edges)[0::2]
    return found


def collection(strings: list[bytes], least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(transform, common prefix with the row before, string, suffix length) of all suffixes, sorted.

    Built column by column: round j inserts the suffix of length j of every string that
    is that long. A suffix c + s goes where the rows with c before them stand in the
    transform: behind all smaller symbols and as many c as precede the row of s. Its
    common prefix with its neighbour is one more than the least one between the two
    rows of the transform that hold their c. Strings hold under 255 bytes, of which the
    symbols used are numbered densely. Of suffixes shorter than ``least`` the string is not
    kept track of, and is given as -1.
    """
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    ends = np.cumsum(size)
    used, joined = np.unique(np.frombuffer(b"".join(strings), np.uint8), return_inverse=True)
    kind = np.uint8 if len(used) < 256 else np.uint16
    # Symbol 0 stands before a whole string.
    joined = np.append((joined + 1).astype(kind), kind(0))
    n = len(strings)
    # At first there are only the empty suffixes.
    transform = np.where(size > 0, joined[ends - 1], 0).astype(kind)
    common = np.zeros(n, np.uint8)
    tracked = np.arange(n) * 256 if least == 0 else np.full(n, -256)
    active, row = np.arange(n), np.arange(n)
    for j in range(1, int(size.max(initial=0)) + 1):
        going = size[active] >= j
        active, row = active[going], row[going]
        # Rows by the symbol before them; each is the place of a suffix one longer.
        order = np.argsort(transform, kind="stable")
        counts = np.bincount(transform, minlength=len(used) + 1)
        begin = np.cumsum(counts) - counts
        symbol = transform[row]
        by = np.lexsort((row, symbol))
        active, row, symbol = active[by], row[by], symbol[by]
        rank = np.empty(len(row), np.int64)
        parts = np.searchsorted(symbol, np.arange(len(used) + 2))
        for c in np.unique(symbol).tolist():
            mine = slice(parts[c], parts[c + 1])
            rank[mine] = begin[c] + np.searchsorted(order[begin[c] : begin[c] + counts[c]], row[mine])
        whole = int(counts[0])
        target = n + rank - whole
        total = len(transform) + len(active)
        old = np.ones(total, bool)
        old[target] = False
        before = np.where(size[active] > j, joined[ends[active] - j - 1], 0)
        # New rows and the rows behind them get their common prefix anew.
        touched = np.zeros(total + 1, bool)
        touched[target] = touched[target + 1] = True
        changed = n + np.flatnonzero(touched[n:total])
        here = order[changed - n + whole]
        there = order[np.maximum(changed - n + whole - 1, 0)]
        same = (changed > n) & (transform[here] == transform[there])
        values = np.zeros(len(changed), np.uint8)
        if same.any():
            values[same] = 1 + _least_between(common, there[same], here[same])
        common = _grown(common, old, target, 0)
        common[changed] = values
        transform = _grown(transform, old, target, before)
        if j == least:
            tracked = np.full(total, -256)
            tracked[target] = active * 256 + j
        elif j > least:
            tracked = _grown(tracked, old, target, active * 256 + j)
        row = target
    if len(tracked) < len(transform):
        tracked = np.full(len(transform), -256)
    symbols = np.append(0, used.astype(np.int64) + 1)
    return symbols[transform], common, tracked >> 8, tracked & 255


def repeats(strings: list[bytes], least: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of every substring of ``least`` bytes that an earlier string, or an
    earlier place of the same one, holds too."""
    _, common, owner, length = collection(strings, least)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    group = np.cumsum(common < least)
    long = np.flatnonzero(owner >= 0)
    start = size[owner[long]] - length[long]
    order = np.lexsort((start, owner[long], group[long]))
    sorted_group = group[long][order]
    later = order[1:][sorted_group[1:] == sorted_group[:-1]]
    return owner[long][later], start[later]


def _shared(key: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Rows whose side, unless it is 0, another row of their key has too."""
    order = np.lexsort((side, key))
    equal = (key[order][1:] == key[order][:-1]) & (side[order][1:] == side[order][:-1])
    found = np.zeros(len(key), bool)
    found[order[1:]] = equal
    found[order[:-1]] |= equal
    return found & (side != 0)


def _spans(doc_id, version, start, length) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(c).astype(np.int64)) for c in (doc_id, version, start, length)],
        names=["doc_id", "version", "start", "length"],
    )


def _collecting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals that repeat between different contexts, or parts of contexts, of one key."""
    for table in whole_runs(batches, ["key"], BLOCK):
        known = table.filter(pc.is_null(table.column("context")))
        yield _spans(*(known.column(c).to_numpy() for c in ("doc_id", "version", "start", "size")))
        table = table.filter(pc.is_valid(table.column("context"))).combine_chunks()
        if not table.num_rows:
            continue
        key, doc_id, version, start, size, before, behind = (c.to_numpy() for c in table.columns[:7])
        code = table.column("context").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((start, version, doc_id, code, key))
        new = np.concatenate(
            [[True], (key[order][1:] != key[order][:-1]) | (code[order][1:] != code[order][:-1])]
        )
        head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        same = (doc_id[order] == doc_id[head]) & (version[order] == version[head]) & (start[order] == start[head])
        later = order[~new & ~same]
        yield _spans(doc_id[later], version[later], start[later], size[later])
        first = order[new]
        long = pc.binary_length(table.column("context")).to_numpy()[first] >= LENGTH
        first = first[long]
        first = first[_shared(key[first], before[first]) | _shared(key[first], behind[first])]
        if not len(first):
            continue
        order = first[np.lexsort((start[first], version[first], doc_id[first]))]
        string, at = repeats(table.column("context").take(pa.array(order)).to_pylist())
        owner, a, b = _merged(string.astype(np.int64), at, at + LENGTH)
        row = order[owner]
        yield _spans(doc_id[row], version[row], start[row] + a, b - a)


def _removing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        out = []
        for text, again, spans in zip(
            texts, batch.column("again").to_pylist(), batch.column("spans").to_pylist(), strict=True
        ):
            found = [(s["start"], s["start"] + s["length"]) for s in spans or ()]
            if again and len(text) >= LENGTH:
                found = [(0, len(text))]
            pairs = np.array(found, np.int64).reshape(-1, 2)
            _, a, b = _merged(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
            edges = [0, *np.stack([a, b], 1).reshape(-1).tolist(), len(text)]
            digest = hashlib.sha256()
            for i in range(0, len(edges), 2):
                digest.update(text[edges[i] : edges[i + 1]])
            out.append((len(text), int((b - a).sum()), len(a), a.tolist(), b.tolist(), digest.hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
        columns = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "starts", "ends", "kept_sha256"],
        )


# Stands for a missing id, which comes before all others.
_NO_ID = -(1 << 63)


def removed_passages(
    docs: DataFrame, hot: int = HOT, hotter: int = HOTTER, together: int = TOGETHER
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, starts, ends, kept_sha256) per row of ``docs(doc_id, text, ...)``.

    A byte goes when a string of 100 bytes that covers it starts earlier too: in a
    document of smaller id, or earlier in the same one. ``starts`` and ``ends`` are the
    maximal runs removed, in bytes of the text as given. A null text counts as empty.
    Rows without an id come before all others; rows of equal id count as different
    documents, in an order of their contents, and of rows that are equal throughout
    all but one repeat it. Other columns are ignored; an empty table gives an empty result.
    From ``hot`` different contexts on an anchor is keyed in parts, from ``hotter`` ones, or of
    more than ``together`` rows, by its strings; the result is the same.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"),
        text_of().alias("text"),
        F.xxhash64(text_of()).alias("version"),
    )
    met = written(
        rows.mapInArrow(_finding, _ROW)
        .repartition(n, "key")
        .sortWithinPartitions("key", "inner", "doc_id", "version", "start")
        .mapInArrow(partial(_meeting, hot=hot, hotter=hotter, together=together), _ROW + ", parts long"),
        "contexts",
    )
    asked = (
        met.where("strings > 0")
        .groupBy("doc_id", "version")
        .agg(F.collect_list(F.struct("key", "start", "strings", "parts")).alias("asked"))
    )
    between = (
        rows.join(asked, ["doc_id", "version"])
        .select("doc_id", "version", "text", "asked")
        .mapInArrow(_cutting, _PIECE)
        .repartition(n, "key")
        .sortWithinPartitions("key")
        .mapInArrow(_collecting, "doc_id long, version long, start long, length long")
    )
    within = met.where("strings < 0").select("doc_id", "version", "start", (-F.col("strings")).alias("length"))
    spans = (
        within.unionByName(between)
        .groupBy("doc_id", "version")
        .agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    )
    again = F.row_number().over(Window.partitionBy("doc_id", "version").orderBy("version")) > 1
    return (
        rows.join(spans, ["doc_id", "version"], "left")
        .select("doc_id", "text", "spans", again.alias("again"))
        .mapInArrow(
            _removing,
            "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept_sha256 string",
        )
        .withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))
    )
