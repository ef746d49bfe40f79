"""Token ids of texts as bytes, with what a worker process has already encoded kept for reuse.

Both public vocabularies split a text into parts that are encoded one by one, and no part crosses from
a letter or sign into a blank, nor from a letter into a sign or digit. So a text may be cut there and the ids
of its pieces joined. The distinct pieces of a batch are looked up once; a worker keeps those of the last two
rounds, and a round ends with ``KEPT`` pieces, so what recurs stays. A worker that has not encoded for ``IDLE``
seconds, such as one that works on another stage, gives them back.
"""

from __future__ import annotations

import re
import threading
import time

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from msgsearch.llm.common import IS_SEPARATOR, LOWER

KEPT = 300_000
IDLE = 5.0
#: Pieces that are encoded in one call.
TOGETHER = 20_000
END = "<|endoftext|>"
#: What the vocabularies' patterns take for white space.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes with A-Z in lower case and ASCII white space as a blank.
PLAIN = np.where(IS_SEPARATOR, 0x20, LOWER).astype(np.uint8)
WIDE_SPACES = [int.from_bytes(c.encode()) for c in map(chr, range(0x80, 0x3001)) if re.match(f"[{SPACES}]", c)]
#: Kinds of characters whose borders end a part: ASCII and Latin letters (of two bytes; not U+0130, whose lower case
#: is more than a letter), ASCII digits and signs. Everything else is 0 and decides nothing.
LETTER, DIGIT, SIGN, LINE = 1, 2, 3, 4
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[[x for x in range(128) if chr(x).isalpha()]] = LETTER
KIND[[x for x in range(128) if chr(x).isdigit()]] = DIGIT
LATIN_LEADS = (0xC3, 0xC5)
NO_LETTERS = [int.from_bytes(c.encode()) for c in "\xd7\xf7\u0130"]
#: One part by itself in both vocabularies.
LETTERS = re.compile(" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]+")


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte of some UTF-8 belongs to."""
    kinds = KIND[data]
    low, high = LATIN_LEADS
    leads = np.flatnonzero((data[:-1] >= low) & (data[:-1] <= high))
    leads = leads[~np.isin(data[leads].astype(np.int64) << 8 | data[leads + 1], NO_LETTERS)]
    kinds[leads] = kinds[leads + 1] = LETTER
    return kinds


def _borders(data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where a character follows one of another kind; an apostrophe may belong to what follows it."""
    found = np.zeros(len(data), bool)
    left, right = kinds[:-1], kinds[1:]
    found[1:] = (left != right) & (left > 0) & (right > 0) & (data[:-1] != ord("'"))
    return found


def _before_spaces(data: np.ndarray) -> np.ndarray:
    """Where ASCII white space follows something else than white space."""
    at = np.flatnonzero(IS_SEPARATOR[data])
    at = at[at > 0]
    at = at[~IS_SEPARATOR[data[at - 1]]]
    wide = at[data[at - 1] >= 0x80]
    code = data[wide - 2].astype(np.int64) << 8 | data[wide - 1]
    spaces = np.isin(code, WIDE_SPACES) | np.isin(data[wide - 3].astype(np.int64) << 16 | code, WIDE_SPACES)
    return np.setdiff1d(at, wide[spaces], assume_unique=True) if spaces.any() else at


class PieceIds:
    """Ids of texts, as little-endian unsigned 32-bit integers, for one vocabulary file.

    Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str):
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.split = Tokenizer.from_file(path)
        self.end = self.split.token_to_id(END)
        # Letters need no pattern and, but for their case, no normal form; lines keep them apart.
        self.letters = Tokenizer.from_file(path)
        if self.letters.normalizer is not None:
            self.letters.normalizer = normalizers.Lowercase()
        lines = pre_tokenizers.Split("\n", "isolated")
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([lines, pre_tokenizers.ByteLevel(False, use_regex=False)])
        (self.line,) = self.letters.encode("\n", add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _learn(self, pieces: list[str], known: dict[str, bytes]) -> None:
        """Encode pieces, many in one call with a token between them that none of them holds."""
        letters, others = [], []
        for x in pieces:
            (letters if LETTERS.fullmatch(x) else others).append(x)
        odd = [x for x in others if "<|" in x]
        for x in odd:
            known[x] = np.asarray(self.plain.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
        plain = [x for x in others if "<|" not in x] if odd else others
        self._together(letters, known, self.letters, "\n", self.line)
        self._together(plain, known, self.split, END, self.end)

    def _together(self, pieces: list[str], known: dict[str, bytes], coder: Tokenizer, mark: str, id: int) -> None:
        for begin in range(0, len(pieces), TOGETHER):
            some = pieces[begin : begin + TOGETHER]
            (found,) = coder.encode_batch_fast([mark.join(some)], add_special_tokens=False)
            ids = np.asarray(found.ids, "<u4")
            stops = np.append(np.flatnonzero(ids == id), len(ids))
            raw, at = ids.tobytes(), 0
            for x, stop in zip(some, stops.tolist(), strict=True):
                known[x] = raw[4 * at : 4 * stop]
                at = stop + 1

    def of(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of some distinct pieces."""
        if len(self.known) > KEPT:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        found = list(map(known.get, pieces))
        if None in found:
            missing = [x for x, ids in zip(pieces, found) if ids is None]
            known.update((x, before[x]) for x in missing if x in before)
            self._learn([x for x in missing if x not in known], known)
            found = list(map(known.__getitem__, pieces))
        return found

    def joined(self, data: np.ndarray, begins: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """Ids of texts, whose bytes lie between ``edges``, from their pieces; no piece crosses an edge."""
        buffers = [pa.py_buffer(np.append(begins, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        coded = pa.LargeStringArray.from_buffers(len(begins), *buffers).dictionary_encode()
        ids = self.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        code = coded.indices.to_numpy(zero_copy_only=False)
        many = np.array([len(x) // 4 for x in ids], np.int64)
        tokens = np.frombuffer(b"".join(ids), "<u4")
        own = many[code]
        stops = np.cumsum(own)
        shift = (np.cumsum(many) - many)[code] - (stops - own)
        raw = tokens[np.arange(stops[-1] if len(stops) else 0) + np.repeat(shift, own)].tobytes()
        ends = np.append(0, stops)[np.searchsorted(begins, edges)] * 4
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def words(self, texts: pa.Array) -> list[bytes]:
        """For vocabularies that drop white space and case, and treat each word by itself."""
        data, edges, starts = _bytes(texts)
        data = PLAIN[data]
        solid = data != 0x20
        starts[1:] |= ~solid[:-1]
        cuts = starts | _borders(data, _kinds(data))
        return self.joined(data[solid], np.flatnonzero(cuts[solid]), np.append(0, np.cumsum(solid))[edges])

    def blanks(self, texts: pa.Array) -> list[bytes]:
        """For byte-level vocabularies, whose parts take the blank before a word along.

        A line end alone between two characters of known kinds is a part by itself.
        """
        data, edges, starts = _bytes(texts)
        kinds = _kinds(data)
        lines = np.flatnonzero((data == ord("\n")) & ~starts)
        kinds[lines[kinds[lines - 1] > 0]] = LINE
        cuts = starts | _borders(data, kinds)
        cuts[_before_spaces(data)] = True
        return self.joined(data, np.flatnonzero(cuts), edges)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, their edges there, and which bytes start one; a null is an empty one."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8, high)[low:] if high > low else np.zeros(0, np.uint8)
    starts = np.zeros(len(data) + 1, bool)
    starts[offsets - low] = True
    return data, offsets - low, starts[:-1]


_held: dict[str, PieceIds] = {}
_used = 0.0
_lock = threading.Lock()


def _release() -> None:
    """Forget everything once nobody has asked for it lately; who still works with it keeps it that long."""
    while True:
        time.sleep(IDLE)
        with _lock:
            if time.monotonic() - _used >= IDLE:
                _held.clear()
                return


def piece_ids(path: str) -> PieceIds:
    """What this worker holds for a vocabulary file."""
    global _used
    with _lock:
        _used = time.monotonic()
        if not _held:
            threading.Thread(target=_release, daemon=True).start()
        if path not in _held:
            _held[path] = PieceIds(path)
        return _held[path]
