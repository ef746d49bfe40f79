"""Language ID: spans of languages in mixed texts.

The script of a word, from the range of its first character, narrows the candidates to the languages that
use this script in training. Byte trigrams with word ends score each word for each candidate. A Viterbi
pass over the words of a text, with a penalty for every change of language, labels spans; the language
with most words is the text's, and its share of the words is the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from msgsearch.llm.common import LOWER, crc32_of_id, text_slices
from msgsearch.session import stored

#: Documents per language that a model is fitted on, chosen by hash.
FIT_EACH = 3000
TRIGRAMS = 1 << 18
SMOOTHING = 0.2
#: Natural logarithms: a change of language, the most that one word says, a word outside its script.
SWITCH = 12.0
MOST_PER_WORD = 6.0
OUTSIDE = 9.0
#: A language uses a script when at least this share of its words does.
SCRIPT_SHARE = 0.005
UNKNOWN = "und"
#: Text bytes that a pass holds at once, each with about a hundred bytes of numbers.
SLICE = 1 << 21
ADDED = [pa.string(), pa.float64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))]

# First code points of Unicode ranges and the script of each (0: no letters).
RANGES = [
    (0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00AA, 1), (0x00AB, 0), (0x00B5, 1), (0x00B6, 0),
    (0x00BA, 1), (0x00BB, 0), (0x00C0, 1), (0x00D7, 0), (0x00D8, 1), (0x00F7, 0), (0x00F8, 1), (0x02B0, 0), (0x0370, 2),
    (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 7), (0x0900, 8), (0x0980, 9), (0x0A00, 10), (0x0E00, 11),
    (0x0E80, 12), (0x0F00, 13), (0x10A0, 14), (0x1100, 15), (0x1200, 16), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C00, 16),
    (0x2E00, 0), (0x3040, 17), (0x3100, 18), (0x3130, 15), (0x3190, 18), (0x3200, 0), (0x3400, 18), (0xA000, 16), (0xAC00, 15),
    (0xD800, 0), (0xF900, 18), (0xFB00, 1), (0xFB10, 5), (0xFB50, 6), (0xFE00, 0), (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1),
    (0xFF5B, 0), (0xFF66, 17), (0xFFA0, 15), (0xFFE0, 0), (0x10000, 16), (0x20000, 18),
]
SCRIPTS = 19
RANGE_STARTS, RANGE_SCRIPTS = (np.array(x) for x in zip(*RANGES))

#: ASCII without letters becomes a blank, upper case lower case; other bytes stay.
CLEAN = LOWER.copy()
CLEAN[[c for c in range(0x80) if not chr(c).isalpha()]] = 0x20


class Spelled:
    """Words of letters in a batch of texts: where they are, their scripts, the trigrams of every byte."""

    def __init__(self, texts: pa.Array):
        raw = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
        low, high = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(raw.buffers()[2], np.uint8, high)[low:] if high > low else np.zeros(0, np.uint8)
        self.offsets = offsets - low
        clean = CLEAN[data]
        latin = np.flatnonzero(data[:-1] == 0xC3) + 1
        capital = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
        clean[capital] += 0x20
        solid = clean != 0x20
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        self.at = np.flatnonzero(solid)
        self.begins = np.flatnonzero(first)
        self.heads = np.flatnonzero(first[self.at])
        self.sizes = np.diff(np.append(self.heads, len(self.at)))
        self.bounds = np.searchsorted(self.begins, self.offsets)
        before = np.append(0x20, clean[:-1]).astype(np.int64)
        after = np.append(clean[1:], 0x20).astype(np.int64)
        if len(data):
            before[edge[:-1]] = 0x20
            after[edge[1:]] = 0x20
        code = ((before << 16) | (clean.astype(np.int64) << 8) | after)[self.at].astype(np.uint64)
        self.trigrams = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)
        self.scripts = self._scripts(data)

    def _scripts(self, data: np.ndarray) -> np.ndarray:
        """The script of each word's first character."""
        padded = np.append(data, np.zeros(4, np.uint8)).astype(np.int64)
        a, b, c, d = (padded[self.begins + k] for k in range(4))
        point = np.select(
            [a < 0x80, a < 0xE0, a < 0xF0],
            [a, (a & 0x1F) << 6 | b & 0x3F, (a & 0xF) << 12 | (b & 0x3F) << 6 | c & 0x3F],
            (a & 7) << 18 | (b & 0x3F) << 12 | (c & 0x3F) << 6 | d & 0x3F,
        )
        return RANGE_SCRIPTS[np.searchsorted(RANGE_STARTS, point, "right") - 1]


@dataclass
class Model:
    """Languages, their trigram log probabilities (trigram x language) and scripts (script x language)."""

    languages: list[str]
    weights: np.ndarray
    uses: np.ndarray
    common: int

    def word_scores(self, spelled: Spelled) -> np.ndarray:
        """Natural log scores per word and language, 0 for the best; equal for all where nothing is known."""
        if not len(spelled.begins):
            return np.zeros((0, len(self.languages)), np.float32)
        scores = np.add.reduceat(self.weights[spelled.trigrams], spelled.heads, axis=0)
        scores = np.maximum(scores - scores.max(1, keepdims=True), -MOST_PER_WORD)
        allowed = self.uses[spelled.scripts]
        scores[~allowed] = -OUTSIDE
        scores[~allowed.any(1)] = 0
        return scores


def labels(scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The best language of each word under the penalty, all texts of a batch a word at a time.

    Ties go to staying in a language, then to the first language.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = bounds[:-1][order], sizes[order]
    out = np.zeros(len(scores), np.min_scalar_type(max(scores.shape[1] - 1, 0)))
    if not len(scores):
        return out
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
    stays = np.zeros(scores.shape, bool)
    came = np.zeros(len(scores), out.dtype)
    best = np.zeros((active[0], scores.shape[1]))
    for step, many in enumerate(active.tolist()):
        row = starts[:many] + step
        if step:
            before = best[:many]
            source = before.argmax(1)
            moved = before[np.arange(many), source] - SWITCH
            stays[row] = before >= moved[:, None]
            came[row] = source
            before = np.maximum(before, moved[:, None])
            best[:many] = before - before.max(1, keepdims=True)
        best[:many] += scores[row]
    state = np.zeros(len(sizes), np.int64)
    for step in range(len(active) - 1, -1, -1):
        many = int(active[step])
        ending = int(active[step + 1]) if step + 1 < len(active) else 0
        state[ending:many] = best[ending:many].argmax(1)
        row = starts[:many] + step
        out[row] = state[:many]
        if step:
            state[:many] = np.where(stays[row, state[:many]], state[:many], came[row])
    return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from texts with their language, on about ``FIT_EACH`` documents of each.

    The sample is chosen by a hash of the row; trigrams are counted in tasks and only the sums, of fixed
    size per language, reach the driver. Null texts and languages teach nothing.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[lang]: r["count"] for r in known.groupBy(lang).count().collect()}
    if not sizes:
        return Model([], np.zeros((TRIGRAMS, 0), np.float32), np.zeros((SCRIPTS, 0), bool), 0)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, FIT_EACH / n))])
    draw = F.pmod(F.xxhash64(*labelled.columns), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = known.where(draw < F.element_at(share, F.col(lang))).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for some in text_slices(batch, "text", SLICE):
                names = some.column("lang").to_pylist()
                for name in set(names):
                    own = Spelled(some.column("text").filter(pa.array([x == name for x in names])))
                    held = sums.setdefault(name, np.zeros(TRIGRAMS + SCRIPTS, np.int64))
                    held[:TRIGRAMS] += np.bincount(own.trigrams, minlength=TRIGRAMS)
                    held[TRIGRAMS:] += np.bincount(own.scripts, minlength=SCRIPTS)
        packed = [zstandard.compress(x.tobytes(), 1) for x in sums.values()]
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array(packed, pa.binary())], ["lang", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None
        for batch in batches:
            for own, packed in zip(*(c.to_pylist() for c in batch.columns)):
                counts = np.frombuffer(zstandard.decompress(packed), np.int64)
                if own == name:
                    held = held + counts
                    continue
                if name is not None:
                    yield pa.record_batch([pa.array([name]), pa.array([held.tobytes()], pa.binary())], ["lang", "counts"])
                name, held = own, counts
        if name is not None:
            yield pa.record_batch([pa.array([name]), pa.array([held.tobytes()], pa.binary())], ["lang", "counts"])

    schema = "lang string, counts binary"
    partial = sample.mapInArrow(count, schema).repartition("lang").sortWithinPartitions("lang")
    rows = stored(partial.mapInArrow(add, schema), "language-model").orderBy("lang").collect()
    counts = np.stack([np.frombuffer(r["counts"], np.int64) for r in rows])
    grams, scripts = counts[:, :TRIGRAMS].astype(float) + SMOOTHING, counts[:, TRIGRAMS:]
    weights = np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32)
    uses = (scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)).T & (scripts.T > 0)
    uses[0] = False
    languages = [r["lang"] for r in rows]
    return Model(languages, np.ascontiguousarray(weights), uses, languages.index(max(languages, key=lambda x: sizes[x])))


def identify(documents: DataFrame, model: Model, text: str = "text", with_spans: bool = False) -> DataFrame:
    """All rows and columns with lang_pred, score and, if asked for, spans.

    ``score`` is the share of the words (of a known script) that bear the language. A null text, an empty one
    or one without letters is ``und`` with score 0. Letters of scripts that no language uses leave the most
    frequent language, with score 0. Spans are (begin, end, lang) in UTF-8 bytes, from word to word, none without a known script. Without
    languages learned everything is ``und``. Input columns of the result's names are replaced.
    """
    added = "lang_pred string, score double" + ", spans array<struct<begin:bigint,end:bigint,lang:string>>" * with_spans
    own = documents.drop("lang_pred", "score", "spans")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*own.schema.fields, *StructType.fromDDL(added).fields])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, text, SLICE):
                found = _predicted(some.column(text), shared.value, with_spans)
                yield pa.record_batch([*some.columns, *(pa.array(x, k) for x, k in zip(found, ADDED))], schema.names)

    return own.mapInArrow(predict, schema)


def _predicted(texts: pa.Array, model: Model, with_spans: bool) -> tuple:
    many = len(model.languages)
    if not many:
        blank = [UNKNOWN] * len(texts), [0.0] * len(texts)
        return (*blank, [[]] * len(texts)) if with_spans else blank
    spelled = Spelled(texts)
    label = labels(model.word_scores(spelled), spelled.bounds)
    counts = model.uses[spelled.scripts].any(1)
    doc = np.repeat(np.arange(len(texts)), np.diff(spelled.bounds))
    votes = np.bincount(doc[counts] * many + label[counts], minlength=len(texts) * many).reshape(len(texts), many)
    total, top = votes.sum(1), votes.argmax(1)
    simple = np.bincount(doc[spelled.scripts == 1], minlength=len(texts)) > 0
    names, scores = [], []
    for i in range(len(texts)):
        if total[i]:
            names.append(model.languages[top[i]])
            scores.append(float(votes[i, top[i]] / total[i]))
        else:
            value = texts[i].as_py()
            lettered = value is not None and (simple[i] or any(c.isalpha() for c in value))
            names.append(model.languages[model.common] if lettered else UNKNOWN)
            scores.append(0.0)
    if not with_spans:
        return names, scores
    ends = spelled.begins + spelled.sizes
    spans = []
    for i in range(len(texts)):
        low, high = int(spelled.bounds[i]), int(spelled.bounds[i + 1])
        high = high if total[i] else low
        heads = np.flatnonzero(np.append(True, np.diff(label[low:high]) != 0)[: high - low]) + low
        tails = np.append(heads[1:], high) - 1
        base = int(spelled.offsets[i])
        spans.append(
            [dict(begin=int(spelled.begins[a]) - base, end=int(ends[b]) - base, lang=model.languages[label[a]]) for a, b in zip(heads, tails) if high > low]
        )
    return names, scores, spans


def held_out(documents: DataFrame, folds: int = 5):
    """Whether a document stays out of the fit: crc32 of its id as text divisible by ``folds``."""
    return crc32_of_id() % folds == 0


def predicted_languages(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from the documents not held out."""
    rows = documents.select("doc_id", "text", "lang").withColumn("held_out", held_out(documents))
    model = fit(rows.where("NOT held_out").select("text", "lang", "doc_id"))
    found = identify(rows.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
