"""Token ids in files of independent zstandard frames with a trailing seek table.

One frame holds one document's ids, little-endian, two bytes each where the
vocabulary allows and four otherwise, with zstandard's own content checksum. After
the frames of a file come two skippable frames: the document ids in order, and the
seek table of the public zstandard seekable format, whose entries give each frame's
compressed size, its content's size and the low half of its content's XXH64. A
reader takes the end of a file first and then only the frames it wants.

Files follow each other in ascending document id. ``spark.checkpoint.dir`` or any
folder that pyarrow's file systems reach may hold them; a task writes under a name
of its own and renames, so one that runs again replaces its own work.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.llm.common import fresh_path, one_by_one, partitions, small_batches, text_of
from postroom.llm.encoding import byte_batches, encoder, tokenizer

END_ID = 2
LEVEL = 3

# Fixed values of the zstandard seekable format, and of skippable frames.
SEEK_TABLE_FRAME = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
SKIPPABLE = 0x184D2A50

_ENTRY = struct.Struct("<III")
_FOOTER = struct.Struct("<IBI")
_SKIP = struct.Struct("<II")
# Before the document ids: bytes per id, and a mark that the first id is missing.
_IDS = struct.Struct("<BI")


def id_width(path: str) -> int:
    return 2 if tokenizer(path).get_vocab_size() <= 1 << 16 else 4


def _checksum(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


def _encoding(path: str, splitters: list[int], end_id: int, width: int) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress
        for rows in byte_batches(batches, "text"):
            keys = rows.column("doc_id").combine_chunks()
            ids, counts = encoder(path).encode(rows.column("text").combine_chunks())
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id).astype(f"<u{width}")
            ends += np.arange(1, len(ends) + 1)
            contents = [ids[a:b].tobytes() for a, b in zip(ends - counts - 1, ends, strict=True)]
            # Rows without an id come before all others.
            known = keys.fill_null(np.iinfo(np.int64).min).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.searchsorted(np.array(splitters, np.int64), known).astype(np.int32)),
                    keys,
                    pa.array([_checksum(c) for c in contents], pa.int64()),
                    pa.array([len(c) for c in contents], pa.int64()),
                    pa.array([squeeze(c) for c in contents], pa.binary()),
                ],
                names=["part", "doc_id", "checksum", "size", "frame"],
            )

    return encode


def write_file(rows: Iterable[tuple], uri: str, width: int) -> tuple[int, int]:
    """Write (doc_id, checksum, size, frame) rows, in order, as one file.

    Returns the numbers of documents and of ids.
    """
    system, path = fs.FileSystem.from_uri(uri)
    attempt = f"{path}.{uuid.uuid4().hex}"
    system.create_dir(path.rpartition("/")[0])
    ids, table, missing, total = [], bytearray(), 0, 0
    with system.open_output_stream(attempt) as out:
        for doc_id, checksum, size, frame in rows:
            out.write(frame)
            missing += doc_id is None
            ids.append(doc_id or 0)
            table += _ENTRY.pack(len(frame), size, checksum)
            total += size // width
        # Rows without an id are sorted first, so their number tells which they are.
        listed = _IDS.pack(width, missing) + np.array(ids, "<i8").tobytes()
        out.write(_SKIP.pack(SKIPPABLE, len(listed)) + listed)
        table += _FOOTER.pack(len(ids), HAS_CHECKSUMS, SEEKABLE)
        out.write(_SKIP.pack(SEEK_TABLE_FRAME, len(table)) + bytes(table))
    system.move(attempt, path)
    return len(ids), total


@dataclass(frozen=True)
class TokenFile:
    """One file's index, and its frames on request."""

    uri: str
    width: int
    doc_ids: list[int | None]
    entries: np.ndarray  # compressed size, content size, checksum per frame
    offsets: np.ndarray

    @classmethod
    def open(cls, uri: str) -> TokenFile:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as file:
            size = file.size()
            frames, flags, magic = _FOOTER.unpack(file.read_at(_FOOTER.size, size - _FOOTER.size))
            if magic != SEEKABLE or flags != HAS_CHECKSUMS:
                raise ValueError(f"{uri} has no seek table")
            table = frames * _ENTRY.size
            start = size - _FOOTER.size - table
            entries = np.frombuffer(file.read_at(table, start), "<u4").reshape(frames, 3).astype(np.int64)
            listed = _IDS.size + 8 * frames
            found = file.read_at(listed, start - _SKIP.size - listed)
        width, missing = _IDS.unpack(found[: _IDS.size])
        ids = np.frombuffer(found[_IDS.size :], "<i8").tolist()
        offsets = np.concatenate([[0], np.cumsum(entries[:, 0])])
        return cls(uri, width, [None] * missing + ids[missing:], entries, offsets)

    def read(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(frame number, ids) of the wanted frames, of all by default; checksums are verified."""
        system, path = fs.FileSystem.from_uri(self.uri)
        expand = zstandard.ZstdDecompressor()
        with system.open_input_file(path) as file:
            for i in range(len(self.entries)) if wanted is None else wanted:
                packed, size, checksum = self.entries[i]
                content = expand.decompress(file.read_at(int(packed), int(self.offsets[i])), max_output_size=int(size))
                if len(content) != size or _checksum(content) != checksum:
                    raise ValueError(f"frame {i} of {self.uri} is damaged")
                yield i, np.frombuffer(content, f"<u{self.width}").astype("<u4")

    def documents(self, doc_ids: set[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) of some documents; no other frame is read."""
        places = [i for i, doc_id in enumerate(self.doc_ids) if doc_id in doc_ids]
        for i, ids in self.read(places):
            yield self.doc_ids[i], ids


def _writing(folder: str, width: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:06d}.tokens"
        documents, ids = write_file(one_by_one(batches), uri, width)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), *(pa.array([x]) for x in (uri, documents, ids))],
            names=["part", "uri", "n_documents", "n_ids"],
        )

    return write


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> list[tuple[str, int]]:
    """Write the ids of ``docs(doc_id, text, ...)`` below ``folder``, in ascending id.

    Texts are encoded where they are read and only compressed frames are shuffled,
    each to the file that holds its range of ids; the ranges come from quantiles of
    the id column. Returns (uri, ids in it) per file, in order: what the driver
    holds grows with the number of files. Equal ids are neighbours.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    files = partitions(spark)
    shares = [i / files for i in range(1, files)] or [0.5]
    found = rows.agg(F.percentile_approx("doc_id", shares, 100 * files).alias("at")).first()["at"]
    splitters = sorted(set(found or []))
    width = id_width(path)
    frames = rows.mapInArrow(
        _encoding(path, splitters, end_id, width),
        "part int, doc_id long, checksum long, size long, frame binary",
    )
    manifest = (
        frames.repartitionById(len(splitters) + 1, F.col("part"))
        .sortWithinPartitions("doc_id", "checksum", "size")
        .select("doc_id", "checksum", "size", "frame")
        .mapInArrow(_writing(folder, width), "part int, uri string, n_documents long, n_ids long")
    )
    return [(row["uri"], row["n_ids"]) for row in sorted(manifest.collect(), key=lambda r: r["part"])]


def _reading(files: list[tuple[str, int]]) -> Callable:
    starts = [0, *accumulate(n for _, n in files)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (number,) in one_by_one(batches):
            file = TokenFile.open(files[number][0])
            lengths = file.entries[:, 1] // file.width
            crcs = [zlib.crc32(ids.tobytes()) for _, ids in file.read()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(file.doc_ids, pa.int64()),
                    pa.array(starts[number] + np.cumsum(lengths) - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(crcs, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return read


def read_token_index(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files' own frames."""
    numbers = spark.range(0, len(files), 1, max(1, len(files)))
    return numbers.mapInArrow(_reading(files), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs(doc_id, text, ...)`` as token files in the shared folder and read them back.

    One row per row of ``docs``: (doc_id, start, n_tokens, ids_crc32). A null text
    counts as empty and holds the end id alone. Rows without an id come first;
    rows with equal ids follow each other by content. Other columns are ignored; an
    empty table gives one empty file and no rows.
    """
    spark = docs.sparkSession
    files = write_token_files(docs, path, fresh_path(spark, "tokens"), end_id)
    return read_token_index(spark, files)
