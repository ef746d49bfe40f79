"""Substring dedup with a count-min prefilter: words inside windows that occur twice or more are removed.

First pass: every window is counted under its anchor, the smallest hash of the twelve-word runs inside it.
Equal windows have equal anchors, and a position is counted once however many windows share it, so the
anchor's count is at least that of the window, at a twelfth of the entries. The counts go into sketches of
two rows, one per partition, merged by cell ranges; only "twice or more" is kept of each cell.

Second pass: windows whose anchor is estimated to repeat are grouped exactly, by a 128-bit identity (hash
of the anchor, hash of the window). Windows that occur twice within a slice of one task are sent once, so
a passage that a third of all texts share stays a few rows per task. A phrase shorter than a window, with
different words around it, gives many different windows one anchor: windows of anchors that a fixed-size
sketch counts as frequent are dealt by their own identity. What comes back are the estimated
windows that are unique after all; texts are joined with those, and everything else that the sketch
reports is removed. The sketch can only report too much, so no repeated window is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from msgsearch.llm.cells import level_of, levels, may_repeat, power_of_two, repeated
from msgsearch.llm.common import Words, inside, mix, runs_hash, text_slices

WINDOW = 35
ANCHOR = 12
#: Cells per counted anchor, as far as ``MOST_CELLS`` allows: two bits in memory for each cell. Beyond it
#: more windows are grouped exactly, none is lost.
CELLS_EACH = 8
MOST_CELLS = 1 << 30
LEAST_CELLS = 1 << 20
#: Cells that count how often suspect anchors occur, and the bit length of a count (8,192 or more) from which
#: the windows of an anchor are grouped one by one. A count is never too low.
LEVEL_CELLS = 1 << 20
HOT_LEVEL = 14
#: A rough count of text bytes per anchor, to choose the number of cells.
BYTES_EACH = 60
FOUND = "anchor bigint, k1 bigint, k2 bigint, start bigint, windows binary"
UNIQUE = "k1 bigint, k2 bigint, start bigint, length bigint"


def _spread(x: np.ndarray, width: int, smallest: bool) -> np.ndarray:
    """The smallest (or largest) of every ``width`` consecutive values."""
    best = np.minimum if smallest else np.maximum
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


class Windows:
    """Windows of a batch of texts: which positions start one, and the anchor of each."""

    def __init__(self, texts: pa.Array, window: int):
        self.words = Words(texts)
        hashes = self.words.hashes
        self.starts = inside(self.words.bounds, window) if len(hashes) else np.zeros(0, bool)
        many = max(0, len(hashes) - window + 1)
        size = min(ANCHOR, window)
        grams = runs_hash(hashes, size)
        span = window - size + 1
        self.grams = grams
        self.anchors = np.zeros(len(hashes), np.uint64)
        if many:
            self.anchors[:many] = _spread(grams, span, True)
        self.anchors[~self.starts] = 0
        self.span = span

    def anchor_hashes(self) -> np.ndarray:
        """The hash of each position that is the anchor of some window, ties included."""
        if not self.starts.any():
            return np.zeros(0, np.uint64)
        padded = np.concatenate((np.zeros(self.span - 1, np.uint64), self.anchors[: len(self.grams)]))
        largest = _spread(padded, self.span, False)
        return self.grams[(largest == self.grams) & (largest > 0)]


def sketch(documents: DataFrame, window: int, cells: int) -> np.ndarray:
    """Which anchors may repeat; its size is fixed by ``cells``."""

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for some in text_slices(batch, "_text"):
            yield Windows(some.column("_text"), window).anchor_hashes()

    return repeated(documents.select("_text"), anchors, cells)


def anchor_levels(documents: DataFrame, window: int, bits: Broadcast) -> np.ndarray:
    """The bit length of how often each suspect anchor occurs, by cells."""

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for some in text_slices(batch, "_text"):
            found = Windows(some.column("_text"), window).anchor_hashes()
            yield found[may_repeat(bits.value, found)]

    return levels(documents.select("_text"), anchors, LEVEL_CELLS)


def _suspects(windows: Windows, bits: np.ndarray) -> np.ndarray:
    """Positions of windows whose anchor may repeat."""
    at = np.flatnonzero(windows.starts)
    return at[may_repeat(bits, windows.anchors[at])]


def _found(windows: Windows, bits: np.ndarray, found: np.ndarray, least: int, window: int, k1: np.ndarray, k2: np.ndarray) -> pa.RecordBatch | None:
    """Suspect windows of a slice: unique ones in stretches with their place, the others once without.

    Windows of anchors from ``least`` in ``found`` on go by anchor and window, equal ones to the same place.
    """
    at = _suspects(windows, bits)
    if not len(at):
        return None
    names = runs_hash(windows.words.hashes, window, 1)[at]
    anchors = windows.anchors[at]
    anchors = np.where(level_of(found, anchors) >= least, mix(anchors) ^ mix(names + np.uint64(1)), anchors)
    order = np.argsort(names, kind="stable")
    fresh = np.append(True, names[order][1:] != names[order][:-1])
    times = np.diff(np.append(np.flatnonzero(fresh), len(at)))
    first = order[fresh]
    alone = np.zeros(len(at), bool)
    alone[first[times == 1]] = True
    text = np.searchsorted(windows.words.bounds, at, "right") - 1
    more = first[times > 1]
    more = more[np.argsort(anchors[more], kind="stable")]
    kept = np.concatenate((np.flatnonzero(alone), more))
    single = np.arange(len(kept)) < len(kept) - len(more)
    place, anchor = at[kept], anchors[kept]
    joined = np.append(False, (anchor[1:] == anchor[:-1]) & (single[1:] == single[:-1]))
    joined[1:] &= ~single[1:] | ((place[1:] == place[:-1] + 1) & (text[kept][1:] == text[kept][:-1]))
    heads = np.flatnonzero(~joined)
    own, lone = text[kept][heads], single[heads]
    ends = np.append(heads, len(kept)) * 8
    raw = pa.Array.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(names[kept].tobytes())])
    columns = [
        pa.array(anchor[heads].view(np.int64)),
        pa.array(k1[own], mask=~lone),
        pa.array(k2[own], mask=~lone),
        pa.array(place[heads] - windows.words.bounds[own], mask=~lone),
        raw.cast(pa.binary()),
    ]
    return pa.record_batch(columns, ["anchor", "k1", "k2", "start", "windows"])


def _unique_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: windows that occur once in all. The last anchor of a batch waits for the next,
    reduced to one entry for each of its windows."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = batch.column("windows").cast(pa.large_binary())
        many = np.asarray(pa.compute.binary_length(raw), np.int64) // 8
        names = np.frombuffer(b"".join(raw.to_pylist()), np.uint64)
        row = np.repeat(np.arange(batch.num_rows), many)
        inner = np.arange(len(names)) - np.repeat(np.cumsum(many) - many, many)
        one = np.asarray(batch.column("k1").is_valid())[row]
        k1, k2, start = (np.asarray(batch.column(n).fill_null(0), np.int64)[row] for n in ("k1", "k2", "start"))
        table = [np.asarray(batch.column("anchor"), np.int64)[row], names, k1, k2, start + inner, one]
        if held is not None:
            table = [np.concatenate(x) for x in zip(held, table)]
        order = np.lexsort((table[1], table[0]))
        table = [x[order] for x in table]
        anchor, names = table[:2]
        fresh = np.append(True, (anchor[1:] != anchor[:-1]) | (names[1:] != names[:-1]))
        heads = np.flatnonzero(fresh)
        table[5][heads[np.diff(np.append(heads, len(names))) > 1]] = False
        table = [x[heads] for x in table]
        last = table[0] == table[0][-1]
        yield _segments([x[~last] for x in table])
        held = [x[last] for x in table]
    if held is not None:
        yield _segments(held)


def _segments(table: list[np.ndarray]) -> pa.RecordBatch:
    """The unique windows as stretches of starts."""
    k1, k2, start = (x[table[5]] for x in table[2:5])
    order = np.lexsort((start, k2, k1))
    k1, k2, start = k1[order], k2[order], start[order]
    next_to = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]) & (start[1:] == start[:-1] + 1)
    heads = np.flatnonzero(np.append(True, ~next_to)[: len(k1)])
    lengths = np.diff(np.append(heads, len(k1)))
    return pa.record_batch([pa.array(x) for x in (k1[heads], k2[heads], start[heads], lengths)], ["k1", "k2", "start", "length"])


def _keyed(documents: DataFrame, text: str) -> DataFrame:
    """``_text`` (null as empty) and 128 bits that identify it; equal texts are judged alike."""
    whole = F.coalesce(F.col(text), F.lit(""))
    second = F.shiftleft(F.octet_length(whole).cast("bigint"), 32).bitwiseXOR(F.crc32(whole))
    return documents.withColumn("_text", whole).withColumn("_k1", F.xxhash64(whole)).withColumn("_k2", second)


def dealt_windows(keyed: DataFrame, window: int, bits: Broadcast) -> DataFrame:
    """The suspect windows of all texts; those of one ``anchor`` (see :func:`_found`) are grouped in one task."""
    found = keyed.sparkSession.sparkContext.broadcast(anchor_levels(keyed, window, bits))
    least = HOT_LEVEL

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, "_text"):
                k1, k2 = (np.asarray(some.column(n), np.int64) for n in ("_k1", "_k2"))
                rows = _found(Windows(some.column("_text"), window), bits.value, found.value, least, window, k1, k2)
                if rows is not None:
                    yield rows

    return keyed.select("_text", "_k1", "_k2").mapInArrow(find, FOUND)


def remove_repeats(documents: DataFrame, text: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """All rows and columns with n_words, n_removed (long) and kept_sha256 (of the kept words joined by blanks).

    Words covered by a window that also starts anywhere else, same text included, are removed from the text
    (``with_text=False`` leaves the text out). A text without such words stays as it is; otherwise what is
    left keeps its inner white space, and a blank stands for each gap. Null texts have no words and stay
    null. Repeated rows are repeats of each other. Texts under ``window`` words and empty tables lose
    nothing. Input columns of the result's names are replaced.
    """
    added = ["n_words", "n_removed", "kept_sha256"]
    own = documents.drop(*added, "_text", "_k1", "_k2", "_runs")
    keyed = _keyed(own, text)
    total = keyed.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    cells = power_of_two(CELLS_EACH * total // BYTES_EACH, LEAST_CELLS, MOST_CELLS)
    spark = documents.sparkSession
    bits = spark.sparkContext.broadcast(sketch(keyed, window, cells))

    grouped = dealt_windows(keyed, window, bits).repartition("anchor").sortWithinPartitions("anchor")
    unique = grouped.mapInArrow(_unique_runs, UNIQUE)
    keys = [F.col("k1").alias("_k1"), F.col("k2").alias("_k2")]
    runs = unique.groupBy(*keys).agg(F.collect_list(F.struct("start", "length")).alias("_runs"))
    joined = keyed.join(runs, ["_k1", "_k2"], "left").drop("_k1", "_k2")
    passed = [c for c in own.columns if c != text]
    schema = own.select(*passed, *([text] if with_text else [])).schema
    schema = schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, "_text"):
                columns = [some.column(n) for n in passed]
                columns += _removed(some, text, bits.value, window, with_text)
                yield pa.record_batch(columns, schema.names)

    return joined.mapInArrow(remove, schema)


def _removed(some: pa.RecordBatch, text: str, bits: np.ndarray, window: int, with_text: bool) -> list[pa.Array]:
    """New texts if asked for, numbers of words and of removed ones, digests of the kept words."""
    windows = Windows(some.column("_text"), window)
    words = windows.words
    twice = np.zeros(len(words.hashes) + 1, bool)
    twice[_suspects(windows, bits)] = True
    for i, runs in enumerate(some.column("_runs")):
        for run in runs.as_py() or ():
            begin = words.bounds[i] + run["start"]
            twice[begin : begin + run["length"]] = False
    at = np.flatnonzero(twice)
    change = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    gone = np.cumsum(change)[:-1] > 0
    before = np.append(0, np.cumsum(gone))
    n_removed = before[words.bounds[1:]] - before[words.bounds[:-1]]
    data, ends = words.data.tobytes(), words.begins + words.sizes
    digests, texts = [], []
    originals = some.column(text) if with_text else None
    for i in range(some.num_rows):
        low, high = int(words.bounds[i]), int(words.bounds[i + 1])
        whole = data[words.offsets[i] : words.offsets[i + 1]]
        if not n_removed[i]:
            kept = [whole]
        else:
            stay = np.flatnonzero(~gone[low:high]) + low
            heads = np.flatnonzero(np.append(True, np.diff(stay) > 1)[: len(stay)])
            tails = np.append(heads[1:], len(stay))
            kept = [data[words.begins[stay[a]] : ends[stay[b - 1]]] for a, b in zip(heads, tails)]
        digests.append(hashlib.sha256(b" ".join(w for part in kept for w in part.split())).hexdigest())
        if with_text:
            texts.append(b" ".join(kept).decode() if n_removed[i] else originals[i].as_py())
    found = [pa.array(np.diff(words.bounds)), pa.array(n_removed), pa.array(digests, pa.string())]
    return ([pa.array(texts, pa.string())] if with_text else []) + found


def removal_digests(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    return remove_repeats(documents.select("doc_id", "text"), window=window, with_text=False)
