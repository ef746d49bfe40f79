"""Helpers of the corpus operators: words of whole batches, stable row numbers, wide hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from msgsearch.session import stored

#: Bytes between words: blank and the controls from tab to carriage return.
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Text bytes that one step of a scan holds at once; a longer word extends the step.
STEP = 1 << 18
#: Positions in a word whose byte keys are kept in a table.
TABLED = 64
#: Bytes of an Arrow batch, unless the session sets a size of its own: what a task's worker and its JVM hold
#: of the texts at once.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep batches small from here on."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.conf().contains(name):
        spark.conf.set(name, str(BATCH))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_keys(places: np.ndarray) -> np.ndarray:
    """The random key of a byte at a place of its word; ``places`` is 256 * place + byte."""
    return mix((places.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


BYTE_KEYS = _byte_keys(np.arange(TABLED * 256))


def _hash_step(data: np.ndarray, starts_here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and hash of the words of one step; words do not cross its ends."""
    solid = ~IS_SEPARATOR[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1] | starts_here[1:]
    begins = np.flatnonzero(first)
    if not len(begins):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    at = np.flatnonzero(solid)
    heads = np.flatnonzero(first[at])
    sizes = np.diff(np.append(heads, len(at)))
    place = np.arange(len(at), dtype=np.int64) - np.repeat(heads, sizes)
    index = place * 256 + data[at]
    if sizes.max() <= TABLED:
        keys = BYTE_KEYS[index]
    else:
        keys = np.where(place < TABLED, BYTE_KEYS[np.minimum(index, TABLED * 256 - 1)], _byte_keys(index))
    hashes = mix(np.bitwise_xor.reduceat(keys, heads) + sizes.astype(np.uint64))
    return begins, sizes, hashes


class Words:
    """The words of a batch of texts, in order: ``hashes``, byte ``begins`` and ``sizes``.

    Text ``i`` owns the words ``bounds[i]`` to ``bounds[i + 1]``. A missing text has none. Equal words
    have equal hashes; different ones share a hash with a chance of 2^-64 (tabulation hashing).
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = _plain(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        low, high = int(offsets[0]), int(offsets[-1])
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8, high)[low:] if raw and high else np.zeros(0, np.uint8)
        self.offsets = offsets - low
        starts_here = np.zeros(len(self.data) + 1, bool)
        starts_here[self.offsets] = True
        parts = []
        begin = 0
        while begin < len(self.data):
            end = _cut(self.data, starts_here, begin)
            piece = LOWER[self.data[begin:end]] if lower else self.data[begin:end]
            begins, sizes, hashes = _hash_step(piece, starts_here[begin:end])
            parts.append((begins + begin, sizes, hashes))
            begin = end
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.begins, self.sizes, self.hashes = (np.concatenate(x) for x in zip(empty, *parts))
        self.bounds = np.searchsorted(self.begins, self.offsets)


def _plain(texts: pa.Array) -> pa.Array:
    """Texts as bytes with 64-bit offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.cast(pa.large_binary()).fill_null(b"")


def _cut(data: np.ndarray, starts_here: np.ndarray, begin: int) -> int:
    """Where a step that begins at ``begin`` may end: after a separator or between texts."""
    end = begin + STEP
    while end < len(data):
        for size in (4096, STEP):
            near = slice(max(begin + 1, end - size), end + 1)
            stops = np.flatnonzero(IS_SEPARATOR[data[near]] | starts_here[: len(data)][near])
            if len(stops):
                return near.start + int(stops[-1])
        end += STEP
    return len(data)


FACTOR = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))


def _powers(base: np.uint64, many: int) -> np.ndarray:
    out = np.full(many, base, np.uint64)
    if many:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def runs_hash(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A hash of every ``length`` consecutive words, by the position of the first of them.

    Differences of one running sum, moved to the same power, so the cost does not depend on the length.
    """
    many = len(hashes) - length + 1
    if many <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + np.uint64(seed)) * _powers(FACTOR, len(hashes)), dtype=np.uint64, out=sums[1:])
    return mix((sums[length:] - sums[:many]) * _powers(INVERSE, many))


def inside(bounds: np.ndarray, length: int) -> np.ndarray:
    """Which positions start a run of ``length`` words that stays in its text; one entry per word."""
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(bounds[-1])
    return room >= length


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` text bytes, so that long texts bound the memory by themselves."""
    if not batch.num_rows:
        return
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0)
    ends = np.cumsum(np.asarray(sizes, np.int64))
    begin = 0
    while begin < batch.num_rows:
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end
    # A worker that waits for its next task should not keep what this batch took.
    pa.default_memory_pool().release_unused()


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """Rows with ``_row``, their number from 0 in ascending ``order`` (names of plain columns).

    They are sorted in ranges and written, so that numbers stay when a task runs again; the counts of
    the ranges, as many as shuffle partitions at most, are summed and broadcast. Rows that are equal in
    ``order`` may change places.
    """
    place = F.monotonically_increasing_id()
    kept = stored(
        rows.repartitionByRange(*map(F.col, order))
        .sortWithinPartitions(*order)
        .select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")),
        label,
    )
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (
        kept.join(F.broadcast(before), "_part")
        .withColumn("_row", F.col("_before") + F.col("_at"))
        .drop("_part", "_at", "_before")
    )


def crc32_of_id(column: str = "doc_id"):
    """Unsigned crc32 of an id as text; null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))
