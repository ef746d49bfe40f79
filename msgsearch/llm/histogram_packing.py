"""Packing by the histogram of lengths: shortest pack first.

Documents become token ids with an end id, cut into pieces of at most ``SIZE``. Only the histogram of
piece lengths (``SIZE`` numbers, whatever the data) goes to the driver. There, lengths are placed longest
first, all pieces of a length at once: into the packs that are shortest so far, or into new ones. A pack
is a pattern of lengths with a count, so the work depends on ``SIZE`` alone. Pieces are then numbered by
length and key, and their number tells pattern, sequence and offset.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from msgsearch.llm.common import numbered, text_slices
from msgsearch.llm.token_bytes import piece_ids
from msgsearch.session import stored

SIZE = 1024
END_ID = 0
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PLACED = ["sequence_id", "offset"]
KINDS = {"bigint": pa.int64(), "binary": pa.binary()}


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> list[tuple[list[list[int]], int]]:
    """Patterns (lists of [length, how often]) with their counts, from how many pieces have each length."""
    packs: list[tuple[int, int, list[list[int]], int]] = []  # -room, order, pattern, count
    made = 0

    def push(room: int, pattern: list[list[int]], count: int) -> None:
        nonlocal made
        made += 1
        heapq.heappush(packs, (-room, made, pattern, count))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not packs or -packs[0][0] < length:
                push(size - length, [[length, 1]], left)
                break
            room, _, pattern, count = heapq.heappop(packs)
            used = min(count, left)
            if used < count:
                push(-room, pattern, count - used)
            last = pattern[-1]
            grown = pattern[:-1] + [[length, last[1] + 1]] if last[0] == length else pattern + [[length, 1]]
            push(-room - length, grown, used)
            left -= used
    return [(pattern, count) for _, _, pattern, count in sorted(packs)]


def slots(counts: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Where the pieces go, by their number in order of falling length: rows of (first piece, pieces of
    this length in a pack, length, first sequence, offset), sorted."""
    firsts, total = {}, 0
    for length in sorted(counts, reverse=True):
        firsts[length], total = total, total + counts[length]
    table, sequence = [], 0
    for pattern, count in pack_histogram(counts, size):
        offset = 0
        for length, often in pattern:
            table.append((firsts[length], often, length, sequence, offset))
            firsts[length] += often * count
            offset += often * length
        sequence += count
    return np.array(sorted(table), np.int64).reshape(-1, 5)


def cut(documents: DataFrame, vocabulary: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents; a null text is an empty one and gives the end id alone."""
    schema = PIECES + ", ids binary" * with_ids
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    closing = struct.pack("<I", END_ID)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, "text"):
                rows = []
                encoded = piece_ids(vocabulary).blanks(some.column("text"))
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encoded, strict=True):
                    ids += closing
                    for start in range(0, len(ids) // 4, size):
                        own = ids[4 * start : 4 * (start + size)]
                        rows.append((doc_id, start, len(own) // 4, zlib.crc32(own), len(ids) // 4, own)[: len(names)])
                yield pa.record_batch([pa.array(c, KINDS[k]) for c, k in zip(zip(*rows), kinds)], list(names))

    return documents.select("doc_id", "text").mapInArrow(pieces, schema)


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces (with doc_id, start, length up to ``size``; other columns pass) with sequence_id and offset.

    Equal pieces are interchangeable; an empty table gives an empty one. Columns sequence_id and offset
    of the input are replaced.
    """
    own = pieces.drop(*PLACED, "_gap", "_row").withColumn("_gap", F.lit(size) - F.col("length"))
    rows = numbered(own, ["_gap", "doc_id", "start", "ids_crc32"], "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = rows.sparkSession.sparkContext.broadcast(slots(counts, size))
    schema = own.drop("_gap").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, often, length, sequence, offset = table.value.T
        for batch in batches:
            row = np.asarray(batch.column("_row"), np.int64)
            slot = np.searchsorted(first, row, "right") - 1
            turn = row - first[slot]
            columns = [batch.column(n) for n in schema.names[:-2]]
            columns.append(pa.array(sequence[slot] + turn // often[slot]))
            columns.append(pa.array(offset[slot] + turn % often[slot] * length[slot]))
            yield pa.record_batch(columns, schema.names)

    return rows.drop("_gap").mapInArrow(place, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed ids (input_ids binary, at most ``SIZE`` ids) and lengths of the pieces of each sequence."""
    part = F.struct("offset", "length", "ids")
    parts = F.array_sort(F.collect_list(part))
    return placed.groupBy("sequence_id").agg(parts.alias("_parts")).select(
        "sequence_id",
        F.transform("_parts", lambda x: x["length"]).alias("lengths"),
        F.aggregate("_parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("input_ids"),
    )


def packed_documents(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Where each piece of each document lies: ``PIECES``, sequence_id, offset.

    The pieces are written first: a range sort reads its input twice, and encoding is the dear part.
    """
    return pack(stored(cut(documents, vocabulary), "cut"))
