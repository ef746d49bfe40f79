"""Fixed-size sketches over hashes, built per partition and merged by cell ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from msgsearch.llm.common import mix
from msgsearch.session import stored

ROWS = 2
#: Cells that are merged together.
BLOCK = 1 << 18
PARTIAL = "block bigint, once binary, twice binary"
Hashes = Callable[[pa.RecordBatch], Iterator[np.ndarray]]


def cells_of(hashes: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """The cell of each hash in each row; ``cells`` is a power of two."""
    for row in range(ROWS):
        yield (mix(hashes + np.uint64(row)) & np.uint64(cells - 1)).astype(np.int64)


def power_of_two(wanted: int, least: int, most: int) -> int:
    size = least
    while size < min(wanted, most):
        size *= 2
    return size


def _packed(cells: np.ndarray) -> bytes:
    return zstandard.compress(np.diff(cells, prepend=0).astype("<u4").tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(raw), "<u4"), dtype=np.int64)


def _merged(state: Callable, add: Callable, done: Callable):
    """A pass over rows sorted by block that holds one block at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, None
        for batch in batches:
            for k, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                if k != block:
                    if block is not None:
                        yield pa.record_batch([pa.array([block], pa.int64()), pa.array([done(held)], pa.binary())], ["block", "cells"])
                    block, held = k, state()
                add(held, once, twice)
        if block is not None:
            yield pa.record_batch([pa.array([block], pa.int64()), pa.array([done(held)], pa.binary())], ["block", "cells"])

    return merge


def _collected(partial: DataFrame, merge: Callable, out: np.ndarray) -> np.ndarray:
    """Merge the partial sketches and fetch the whole one, whose size is that of ``out``."""
    merged = partial.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block bigint, cells binary")
    for row in stored(merged, "sketch").toLocalIterator():
        out[row["block"]] = np.frombuffer(row["cells"], out.dtype)
    return out


def repeated(rows: DataFrame, hashes: Hashes, cells: int) -> np.ndarray:
    """Per row and cell one bit: some hash there was counted twice or more. ``hashes`` may repeat a hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.zeros(0, np.uint64)]
        for batch in batches:
            parts += hashes(batch)
        blocks, once, twice = [], [], []
        for row, own in enumerate(cells_of(np.concatenate(parts), cells)):
            own, times = np.unique(own, return_counts=True)
            edges = np.searchsorted(own, np.arange(0, cells + BLOCK, BLOCK))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                part, n = own[edges[k] : edges[k + 1]] - k * BLOCK, times[edges[k] : edges[k + 1]]
                blocks.append(row * (cells // BLOCK) + k)
                once.append(_packed(part[n == 1]))
                twice.append(_packed(part[n > 1]))
        columns = [pa.array(blocks, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())]
        yield pa.record_batch(columns, ["block", "once", "twice"])

    def add(held: np.ndarray, once: bytes, twice: bytes) -> None:
        seen, again = held
        for cells_once, cells_twice in [(_unpacked(once), _unpacked(twice))]:
            again[cells_once[seen[cells_once]]] = True
            again[cells_twice] = True
            seen[cells_once] = seen[cells_twice] = True

    merge = _merged(lambda: np.zeros((2, BLOCK), bool), add, lambda held: np.packbits(held[1]).tobytes())
    bits = np.zeros((ROWS * (cells // BLOCK), BLOCK // 8), np.uint8)
    return _collected(rows.mapInArrow(count, PARTIAL), merge, bits).reshape(ROWS, cells // 8)


def may_repeat(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may have been counted twice or more; all that were are among them."""
    hit = np.ones(len(hashes), bool)
    for row, cell in enumerate(cells_of(hashes, bits.shape[1] * 8)):
        hit &= (bits[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return hit


def levels(rows: DataFrame, hashes: Hashes, cells: int) -> np.ndarray:
    """Per row and cell the bit length of its count: a coarse frequency, never too low."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((ROWS, cells), np.int64)
        for batch in batches:
            for own in hashes(batch):
                for row, cell in enumerate(cells_of(own, cells)):
                    sums[row] += np.bincount(cell, minlength=cells)
        parts = [zstandard.compress(x.tobytes(), 1) for x in sums.astype("<u4").reshape(-1, BLOCK)]
        columns = [pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary()), pa.nulls(len(parts), pa.binary())]
        yield pa.record_batch(columns, ["block", "once", "twice"])

    def add(held: np.ndarray, once: bytes, _: bytes) -> None:
        held += np.frombuffer(zstandard.decompress(once), "<u4")

    merge = _merged(lambda: np.zeros(BLOCK, np.int64), add, lambda held: np.frexp(held.astype(float))[1].astype(np.uint8).tobytes())
    found = np.zeros((ROWS * (cells // BLOCK), BLOCK), np.uint8)
    return _collected(rows.mapInArrow(count, PARTIAL), merge, found).reshape(ROWS, cells)


def level_of(found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return np.minimum(*(found[row][cell] for row, cell in enumerate(cells_of(hashes, found.shape[1]))))
