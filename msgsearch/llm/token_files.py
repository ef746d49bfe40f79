"""Token ids in seekable files: independent zstandard frames, a document table and a seek table.

A file is a row of zstandard frames, each of ``FRAME_IDS`` ids (little-endian unsigned 32-bit) and
readable by itself, then a skippable frame with the document table (ids and token counts, in file order),
then the seek table of the public zstandard seekable format: compressed size, size and checksum (low half
of xxhash64) of every frame. A reader finds a document's ids by its place in the document table and
decompresses only the frames that hold them. Any zstandard program can unpack the whole file.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from msgsearch.llm.common import text_slices
from msgsearch.llm.token_bytes import piece_ids
from msgsearch.session import scratch_dir, stored

FRAME_IDS = 1 << 16
LEVEL = 3
TABLE_MAGIC = 0x184D2A50
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
#: The end of the seek table: frame count, descriptor with the checksum bit, magic.
FOOTER = struct.Struct("<IBI")
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
WRITTEN = "part int, file string, docs bigint, tokens bigint, first_id bigint, last_id bigint"
READ = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def _check(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class TokenFileWriter:
    """Writes documents one after the other; the file takes its name only when complete."""

    def __init__(self, path: str):
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        context = TaskContext.get()
        attempt = context.taskAttemptId() if context else os.getpid()
        self.draft = f"{self.path}.{attempt}.draft"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.draft)
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.waiting, self.waits = [], 0
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.waiting.append(ids)
        self.waits += len(ids)
        if self.waits >= 4 * FRAME_IDS:
            joined = b"".join(self.waiting)
            whole = len(joined) - len(joined) % (4 * FRAME_IDS)
            for begin in range(0, whole, 4 * FRAME_IDS):
                self._frame(joined[begin : begin + 4 * FRAME_IDS])
            self.waiting, self.waits = [joined[whole:]], len(joined) - whole

    def _frame(self, raw: bytes) -> None:
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), _check(raw)))

    def close(self) -> None:
        if self.waits:
            self._frame(b"".join(self.waiting))
        known = np.array([x is not None for x in self.ids], np.uint8)
        table = b"".join(
            (
                np.array([x or 0 for x in self.ids], "<i8").tobytes(),
                np.array(self.counts, "<u8").tobytes(),
                known.tobytes(),
            )
        )
        packed = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(table)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(packed)) + packed)
        self.entries.append((len(packed) + 8, 0, _check(b"")))
        seek = np.array(self.entries, ENTRY).tobytes() + FOOTER.pack(len(self.entries), 0x80, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(seek)) + seek)
        self.out.close()
        self.fs.move(self.draft, self.path)


class TokenFile:
    """Reads one file; frames are read and checked as they are needed."""

    def __init__(self, path: str):
        fs, inner = pafs.FileSystem.from_uri(path)
        self.source = fs.open_input_file(inner)
        size = self.source.size()
        many, flags, magic = FOOTER.unpack(self.source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError(f"no seek table in {path}")
        length = ENTRY.itemsize * many
        seek = np.frombuffer(self.source.read_at(length, size - FOOTER.size - length), ENTRY)
        ends = np.cumsum(seek["packed"].astype(np.int64))
        self.frames, self.at = seek[:-1], np.append(0, ends)[:-1]
        self.unpack = zstandard.ZstdDecompressor()
        table = self.unpack.decompress(self.source.read_at(int(seek["packed"][-1]) - 8, int(self.at[-1]) + 8))
        docs = len(table) // 17
        self.doc_ids = np.frombuffer(table, "<i8", docs)
        self.counts = np.frombuffer(table, "<u8", docs, 8 * docs).astype(np.int64)
        self.known = np.frombuffer(table, np.uint8, docs, 16 * docs).astype(bool)
        self.starts = np.cumsum(self.counts) - self.counts
        self.frame_read, self.held = 0, (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            entry = self.frames[k]
            raw = self.unpack.decompress(self.source.read_at(int(entry["packed"]), int(self.at[k])), int(entry["size"]))
            if len(raw) != entry["size"] or _check(raw) != entry["check"]:
                raise ValueError(f"frame {k} is damaged")
            self.held = (k, raw)
            self.frame_read += 1
        return self.held[1]

    def ids(self, k: int) -> bytes:
        """Ids of the k-th document, from the frames that hold them."""
        begin, end = int(self.starts[k]), int(self.starts[k] + self.counts[k])
        frames = range(begin // FRAME_IDS, -(-end // FRAME_IDS))
        parts = (self.frame(f)[4 * max(0, begin - f * FRAME_IDS) : 4 * (end - f * FRAME_IDS)] for f in frames)
        return b"".join(parts)

    def find(self, doc_id: int) -> list[int]:
        """Places of a document id; more than one if the id repeats."""
        return np.flatnonzero(self.known & (self.doc_ids == doc_id)).tolist()


def write_files(documents: DataFrame, path: str, encode: Callable[[pa.Array], list[bytes]]) -> DataFrame:
    """Encode all documents and write them in ascending doc_id order; returns one row per file.

    ``documents`` has doc_id (null first) and text (null: as an empty one); other columns stay behind. Rows
    with equal ids are written each, in an order that their texts decide, over as many files as they need; rows
    equal in both share one. An empty table writes no file. A task that runs again writes the same file again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        file = f"tokens-{part:06d}.zst"
        out = None
        for batch in batches:
            for some in text_slices(batch, "text"):
                out = out or TokenFileWriter(f"{path}/{file}")
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encode(some.column("text")), strict=True):
                    out.add(doc_id, ids)
        if out:
            out.close()
            known = [x for x in out.ids if x is not None]
            row = (part, file, len(out.ids), sum(out.counts), min(known, default=None), max(known, default=None))
            names = [x.split()[0] for x in WRITTEN.split(", ")]
            kinds = [pa.int32(), pa.string()] + [pa.int64()] * 4
            yield pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], names)

    order = ["doc_id", F.xxhash64("text")]
    ranged = documents.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.mapInArrow(write, WRITTEN), "token-files")


def read_files(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """All documents of the files: doc_id, start (ids before it, over all files), n_tokens, ids.

    Each file is read by one task, frame by frame. The list of files, as many as the writer had
    partitions at most, is the only thing the driver holds.
    """
    listed, before = [], 0
    for row in files.orderBy("part").collect():
        listed.append((row["file"], before))
        before += row["tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(*(c.to_pylist() for c in batch.columns)):
                opened = TokenFile(f"{path}/{file}")
                rows: list[tuple] = []
                held = 0
                for k, known in enumerate(opened.known.tolist()):
                    ids = opened.ids(k)
                    doc_id = int(opened.doc_ids[k]) if known else None
                    rows.append((doc_id, base + int(opened.starts[k]), int(opened.counts[k]), ids))
                    held += len(ids)
                    if held >= 1 << 23:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    if not listed:
        return spark.createDataFrame([], READ)
    plan = spark.createDataFrame(listed, "file string, base bigint").repartition(len(listed))
    return plan.mapInArrow(read, READ)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.record_batch(arrays, ["doc_id", "start", "n_tokens", "ids"])


def fetch(path: str, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the wanted documents only (a column doc_id): other frames stay packed."""
    ranges = files.where("first_id IS NOT NULL").select("file", "first_id", "last_id")
    asked = wanted.select("doc_id").distinct().join(F.broadcast(ranges), F.col("doc_id").between(F.col("first_id"), F.col("last_id")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        for batch in batches:
            for doc_id, file in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    opened, name = TokenFile(f"{path}/{file}"), file
                found = [opened.ids(k) for k in opened.find(doc_id)]
                if found:
                    yield pa.record_batch([pa.array([doc_id] * len(found)), pa.array(found, pa.binary())], ["doc_id", "ids"])

    sorted_requests = asked.select("doc_id", "file").repartition("file").sortWithinPartitions("file", "doc_id")
    return sorted_requests.mapInArrow(read, "doc_id bigint, ids binary")


def word_encoder(vocabulary: str, end: int = 1) -> Callable[[pa.Array], list[bytes]]:
    """Encodes with a vocabulary file that treats words by themselves; every document ends with ``end``."""
    closing = struct.pack("<I", end)
    return lambda texts: [x + closing for x in piece_ids(vocabulary).words(texts)]


def token_digests(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Write the documents' tokens, read the files back and sum each document up."""
    spark = documents.sparkSession
    path = scratch_dir(spark, "tokens")
    files = write_files(documents, path, word_encoder(vocabulary))
    back = read_files(spark, path, files)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
