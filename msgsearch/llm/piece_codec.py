"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The vocabulary file gives pieces and their order. A piece's score is the logarithm of its share under
Zipf's law by that order, in whole 64ths, so that sums are exact; the best segmentation has the highest
sum. The file's own numbers are merge ranks, which no sum of scores can follow, so ids are those of a
unigram model over this vocabulary (which the sentencepiece library reproduces when given these scores).

The pass keeps a window. Whenever all paths that can still win go through one boundary, the ids before it are
final and leave the window, so memory does not grow with the text: paths are compared when no piece crosses a
boundary, and when the window is twice as wide as the longest piece. Some boundaries are final in advance, as
no piece has both characters beside them (a blank after another character, for one); what lies between two
such boundaries recurs, takes the pass once and is then known to the worker.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from msgsearch.llm.common import text_slices

BLANK = "▁"
#: Scores are whole numbers of this part of a natural logarithm.
PART = 64
#: Zipf's law: the share of the piece in place k is in proportion to 1 / (k + SHIFT).
SHIFT = 2.7
#: What an unknown character costs beyond the worst piece, in natural logarithms.
UNKNOWN = 10
KEPT = 1_000_000
SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+$")
#: Parts up to this length are kept with their ids; all take the same pass.
KEPT_LENGTH = 64
#: Characters handed to the pass at once.
CHUNK = 1 << 14


def zipf_score(place: int) -> int:
    return -round(PART * float(np.log(place + SHIFT)))


class Vocabulary:
    """Pieces, scores and bytes of a vocabulary file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(len(self.pieces))]
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.values = {i: b for b, i in self.bytes.items()}
        self.hidden = {i for i, odd in enumerate(special) if odd} - set(self.values)
        plain = [i for i, odd in enumerate(special) if not odd]
        ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.scores = {i: zipf_score(place) for place, i in enumerate(ranked)}
        self.ids = {self.pieces[i]: i for i in plain}
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.scores.values()) - UNKNOWN * PART
        self.scores_of = {p: self.scores[i] for p, i in self.ids.items()}
        #: Neighbouring characters inside pieces: no piece crosses a boundary between others.
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        #: Every beginning of a piece, so that a scan of pieces at a place ends early.
        self.beginnings = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}


class Stream:
    """Encodes one text given in parts; ``ids`` grows as boundaries become final.

    Of equal sums the path whose last piece is longest wins, as in the library. Boundaries are counted from
    where the kept text begins; what lies before ``base`` is final and dropped now and then.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.text = ""
        # The window begins at base; pieces before at have been looked up, and reach up to furthest.
        self.base = self.at = self.furthest = 0
        # Per boundary: the best sum, and where its last piece begins.
        self.sums: list[int | None] = [0]
        self.origin = [0]
        self.ids: list[int] = []
        self.widest = 0
        self.look = 2 * vocabulary.longest  # how wide a window gets before its paths are compared

    def feed(self, part: str) -> None:
        if self.base >= CHUNK:
            self._drop()
        self.text += part
        self._scan(len(self.text) - self.vocabulary.longest + 1)

    def finish(self) -> list[int]:
        self._scan(len(self.text))
        return self.ids

    def _drop(self) -> None:
        base = self.base
        self.text, self.sums, self.origin = self.text[base:], self.sums[base:], [o - base for o in self.origin[base:]]
        self.base, self.at, self.furthest = 0, self.at - base, self.furthest - base

    def _scan(self, stop: int) -> None:
        """Extend the paths that reach each boundary before ``stop`` by every piece there."""
        words, text, sums, origin = self.vocabulary, self.text, self.sums, self.origin
        scores, beginnings, longest, size = words.scores_of, words.beginnings, words.longest, len(text)
        sums += [None] * (size + 1 - len(sums))
        origin += [0] * (size + 1 - len(origin))
        at, furthest = self.at, self.furthest
        while at < stop:
            total, single = sums[at], False
            for end in range(at + 1, min(at + longest, size) + 1):
                piece = text[at:end]
                if piece not in beginnings:
                    break
                score = scores.get(piece)
                if score is not None:
                    single |= end == at + 1
                    if sums[end] is None or total + score > sums[end]:
                        sums[end], origin[end] = total + score, at
                        if end > furthest:
                            furthest = end
            if not single and (sums[at + 1] is None or total + words.unknown > sums[at + 1]):
                sums[at + 1], origin[at + 1] = total + words.unknown, at
                furthest = max(furthest, at + 1)
            at += 1
            if furthest == at:  # every piece so far ends here: nothing crosses this boundary
                self.at = self.furthest = at
                self._commit(at)
            elif at - self.base >= self.look:
                self.at, self.furthest = at, furthest
                self._converged()
        self.at, self.furthest = at, furthest

    def _converged(self) -> None:
        """Commit up to the last boundary that all open paths share."""
        paths = {b for b in range(self.at, self.furthest + 1) if self.sums[b] is not None}
        while len(paths) > 1:
            last = max(paths)
            paths.remove(last)
            paths.add(self.origin[last])
        (shared,) = paths
        self._commit(shared)
        # A window whose paths do not meet is compared again when it is twice as wide.
        self.look = max(self.look, 2 * (self.at - self.base))

    def _commit(self, boundary: int) -> None:
        """Write the ids before a boundary and begin the window there."""
        words, out, at = self.vocabulary, [], boundary
        while at > self.base:
            begin = self.origin[at]
            found = words.ids.get(self.text[begin:at])
            if found is not None:
                out.append(found)
            else:
                out.extend(words.bytes[b] for b in reversed(self.text[begin:at].encode()))
            at = begin
        out.reverse()
        self.ids += out
        self.widest = max(self.widest, self.furthest - self.base)
        self.base, self.look = boundary, 2 * words.longest


class Codec:
    """Encodes and decodes texts with what a worker has already encoded kept for reuse."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.known: dict[str, bytes] = {}

    def segment(self, text: str) -> bytes:
        """Ids of what no piece leaves or enters, by parts that no piece crosses and that recur."""
        inner = self.vocabulary.inner
        cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in inner]
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        return b"".join([self.known.get(x) or self.stream(x) for x in parts])

    def stream(self, text: str) -> bytes:
        """The pass over a text."""
        passing = Stream(self.vocabulary)
        for begin in range(0, len(text), CHUNK):
            passing.feed(text[begin : begin + CHUNK])
        ids = passing.finish()
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(text) <= KEPT_LENGTH:
            self.known[text] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; an empty text has none."""
        if not text:
            return b""
        known = self.known
        segments = SEGMENT.findall(BLANK + text.replace(" ", BLANK))
        found = list(map(known.get, segments))
        if None in found:
            if len(known) > KEPT:
                known.clear()
            for i, ids in enumerate(found):
                if ids is None:
                    piece = segments[i]
                    found[i] = known.get(piece) or self.segment(piece)
                    if len(piece) <= KEPT_LENGTH:
                        known[piece] = found[i]
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        """The text of ids; blanks come back as blanks, and the one put first is taken away."""
        words, parts, raw = self.vocabulary, [], bytearray()
        for i in np.frombuffer(ids, "<u4").tolist():
            if i in words.values:
                raw.append(words.values[i])
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in words.hidden:
                parts.append(words.pieces[i])
        if raw:
            parts.append(raw.decode("utf-8", "replace"))
        text = "".join(parts).replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(documents: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """All rows and columns with ``ids`` (binary, little-endian unsigned 32-bit) of the text.

    A null text has null ids, an empty one no ids. Input columns named ids are replaced. The sign that
    stands for a blank in pieces is a blank after decoding, as in the library.
    """
    own = documents.drop("ids")
    schema = StructType([*own.schema.fields, *StructType.fromDDL("ids binary").fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, text):
                made = codec(vocabulary)
                ids = [None if x is None else made.encode(x) for x in some.column(text).to_pylist()]
                yield pa.record_batch([*some.columns, pa.array(ids, pa.binary())], schema.names)

    return own.mapInArrow(rows, schema)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """All rows and columns with ``decoded``, the text of the ids; null ids give null."""
    own = encoded.drop("decoded")
    schema = StructType([*own.schema.fields, *StructType.fromDDL("decoded string").fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, ids):
                made = codec(vocabulary)
                texts = [None if x is None else made.decode(x) for x in some.column(ids).to_pylist()]
                yield pa.record_batch([*some.columns, pa.array(texts, pa.string())], schema.names)

    return own.mapInArrow(rows, schema)


def coded_documents(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_crc32, and whether decoding gives the text back."""
    found = decode(encode(documents.select("doc_id", "text"), vocabulary), vocabulary)
    ids = F.coalesce("ids", F.lit(b""))
    same = F.coalesce("decoded", F.lit("")) == F.coalesce(F.translate("text", BLANK, " "), F.lit(""))
    return found.select(
        "doc_id",
        F.call_function("div", F.octet_length(ids), F.lit(4)).alias("n_tokens"),
        F.crc32(ids).alias("ids_crc32"),
        F.crc32(F.coalesce("decoded", F.lit(""))).alias("decoded_crc32"),
        same.alias("round_trip"),
    )
