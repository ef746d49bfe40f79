"""Fill-in-the-middle: documents cut at two unit borders and reordered around three marks.

Units are found on the UTF-8 bytes, eight at a time. The bytes of a batch are viewed as unsigned 64-bit
words; arithmetic inside each word marks the bytes that end a unit, and the set marks are counted word by
word. A cut after k units is then a select: a search in the running sum of the counts gives the word, and
a multiplication and a comparison inside it the byte. The same counts over the bytes that begin a code
point give lengths in characters. No unit and no character is ever made an object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from msgsearch.llm.common import text_slices

# The marks, and the shares of documents that are changed and of those in the order S, P, M.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHANGED_PERCENT = 50
SUFFIX_FIRST_PERCENT = 80
SEED = 42
#: Text bytes that one pass holds; a longer text extends the pass.
SLICE = 1 << 21

ONES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)
LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
BLANK = ONES * np.uint64(0x20)


def _every(byte: int) -> np.uint64:
    return ONES * np.uint64(byte)


def _words(data: np.ndarray) -> np.ndarray:
    """Bytes as words, padded with blanks; the first byte is the lowest."""
    padded = np.full(-(-len(data) // 8) * 8, 0x20, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def separators(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is a blank or a control from tab to carriage return.

    Sums stay inside their byte, since the seven low bits and the addends never reach 256.
    """
    low = words & LOW7
    control = (low + _every(0x80 - 0x09)) & ~(low + _every(0x80 - 0x0E)) & ~words
    other = words ^ BLANK
    blank = ~(((other & LOW7) + LOW7) | other)
    return (control | blank) & HIGH


def unit_ends(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The high bit of every byte that ends a unit; ``bounds`` are the texts' borders in ``data``.

    A unit is a run of separators with the run of other characters behind it, or what separators end a
    text. So it ends where a separator follows a byte that is none, and at the last byte of a text.
    """
    blank = separators(_words(data))
    after = np.append(blank[1:], HIGH)[: len(blank)]
    ends = ~blank & HIGH & ((blank >> np.uint64(8)) | (after << np.uint64(56)))
    ends.view(np.uint8)[bounds[1:][np.diff(bounds) > 0] - 1] = 0x80
    return ends


def point_starts(data: np.ndarray) -> np.ndarray:
    """The high bit of every byte that begins a code point; not kept clear behind the data."""
    words = _words(data)
    return ~(words & ~(words << np.uint64(1))) & HIGH


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marked: np.ndarray):
        self.marked = np.append(marked, np.uint64(0))
        self.through = np.cumsum(np.bitwise_count(self.marked), dtype=np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marks lie before each byte position."""
        word, bits = at >> 3, ((at & 7) * 8).astype(np.uint64)
        own = self.marked[word]
        rest = np.bitwise_count(own >> bits)
        return self.through[word] - rest

    def select(self, number: np.ndarray) -> np.ndarray:
        """The byte position of each mark, by its number from 1."""
        word = np.searchsorted(self.through, number)
        own = self.marked[word]
        inside = number - (self.through[word] - np.bitwise_count(own))
        # Byte j of the product counts the marks in bytes 0 to j.
        counts = (own >> np.uint64(7)) * ONES
        reached = ((counts | HIGH) - inside.astype(np.uint64) * ONES) & HIGH
        return word * 8 + 8 - np.bitwise_count(reached)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one run of bytes, and their borders in it."""
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(raw.buffers()[2], np.uint8, high)[low:] if high > low else np.zeros(0, np.uint8)
    return data, offsets - low


OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n", pa.int64()),
        ("form", pa.string()),
        ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64()),
        ("output", pa.string()),
    ]
)


def _transformed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One batch of doc_id, text and h1 to h4."""
    data, bounds = _bytes(batch.column("text"))
    units, points = Marks(unit_ends(data, bounds)), Marks(point_starts(data))
    before = units.rank(bounds)
    n = np.diff(before)
    h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in range(1, 5))
    cuts = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    places = []
    for after in cuts:
        place = bounds[:-1].copy()
        some = after > 0
        place[some] = units.select(before[:-1][some] + after[some]) + 1
        places.append(place)
    chars = np.diff([points.rank(x) for x in (bounds[:-1], *places)], axis=0)
    raw = data.tobytes()
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    forms, outputs = [], []
    for begin, first, second, end, draw, order in zip(bounds[:-1].tolist(), *(p.tolist() for p in places), bounds[1:].tolist(), h3.tolist(), h4.tolist()):
        text = raw[begin:end]
        if not text or draw % 100 >= CHANGED_PERCENT or any(m in text for m in marks):
            forms.append("plain")
            outputs.append(text)
            continue
        prefix, middle, suffix = raw[begin:first], raw[first:second], raw[second:end]
        p, s, m = marks
        if order % 100 < SUFFIX_FIRST_PERCENT:
            forms.append("spm")
            outputs.append(b"".join((s, suffix, p, prefix, m, middle)))
        else:
            forms.append("psm")
            outputs.append(b"".join((p, prefix, s, suffix, m, middle)))
    plain = np.array([f == "plain" for f in forms], bool)
    columns = [batch.column("doc_id"), pa.array(n), pa.array(forms, pa.string())]
    columns += [pa.array(c.astype(np.int64), mask=plain) for c in chars]
    return pa.RecordBatch.from_arrays([*columns, pa.array(outputs, pa.binary()).cast(pa.string())], schema=OUT)


def _draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 that follow from the seed and a key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def transform(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document.

    ``n`` is the number of units of the text. ``form`` is plain (the text as it is), psm or spm; the two
    lengths, in code points, are null for plain. Draws follow from the seed and doc_id alone, so equal rows
    give equal rows. A null text counts as an empty one, which is plain with n = 0; a null doc_id draws as an
    empty string. Texts that hold a mark stay plain. Other columns, whatever their names, are left behind; an
    empty table gives an empty one. Texts are worked on whole; a batch is cut into slices of ``SLICE`` bytes,
    so a very long text needs a small multiple of its own size and nothing else does.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"), *_draws(F.col("doc_id"), seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, "text", SLICE):
                yield _transformed(some)

    return rows.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    No part holds a mark, and a mark begins with a character that it does not hold again, so the first
    occurrence of each mark is its own.
    """
    first = F.substring_index

    def behind(mark: str) -> Column:
        return F.substring(output, F.locate(mark, output) + 3, F.length(output))

    middle = behind(MIDDLE)
    prefix_first = F.concat(
        first(F.substring(output, F.lit(4), F.length(output)), SUFFIX, 1), middle, first(behind(SUFFIX), MIDDLE, 1)
    )
    suffix_first = F.concat(
        first(behind(PREFIX), MIDDLE, 1), middle, first(F.substring(output, F.lit(4), F.length(output)), PREFIX, 1)
    )
    return F.when(form == "psm", prefix_first).when(form == "spm", suffix_first).otherwise(output)


def fill_digests(documents: DataFrame) -> DataFrame:
    """:func:`transform` with sha256 digests of the output and of the text rebuilt from it."""
    done = transform(documents)
    return done.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
