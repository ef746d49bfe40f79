"""Language-model scoring with a class-based bigram model (Brown's model, classes by exchange).

P(word | word before) = P(class | class before) * P(word | class). The most frequent words, the core, are put
into classes by the exchange algorithm: a word moves to the class that raises the likelihood of all class
pairs most. Then every other word that occurs ``LEAST_CLASSED`` times gets the class that makes it likeliest
among the classes of its neighbours, all words at once, and transitions are counted anew over all texts.
Rarer words belong to classes by shape (letters beyond ASCII, digits, signs, closing marks), known without a
table; every document ends with an end token, the only member of its class, which also stands before the
first word. Counts of words, word pairs and classes cover all training texts.

A word that training never saw shares what its shape's words seen once suggest (Good and Turing) with all
other unseen words of the shape, whose number is estimated from the words seen once and twice (Chao). So it
is never likelier than a word seen once.

What workers hold is bounded: classes and counts of the ``HELD`` most frequent words. The counts of rarer words
are joined by key; none of these keys is frequent, and their class is their shape's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from msgsearch.llm.common import Words, crc32_of_id, small_batches, text_slices
from msgsearch.session import stored

#: Words of the core, classes for them, passes over all of them: the model's dimensions.
CORE = 4096
CLASSES = 64
SWEEPS = 3
#: Words whose counts and classes workers hold: about 50 bytes each.
HELD = 1 << 20
#: Occurrences from which a held word outside the core gets a class by its neighbours.
LEAST_CLASSED = 5
SHAPES = 16
#: Keys that a counting task holds beside their sums before it sums them up.
TALLIED = 1 << 20
TRANSITION = 0.1
#: Steps per doubling in which word counts are grouped to find a cut.
BINS = 64
COUNTED = "word bigint, shape int, n bigint"
PAIRED = "code bigint, n bigint"
PACKED = "word bigint, after binary, after_n binary, before binary, before_n binary"
CLOSING = np.isin(np.arange(256), list(b".,;:!?"))
DIGIT = np.isin(np.arange(256), list(b"0123456789"))
SIGN = np.array([c < 0x80 and not chr(c).isalnum() and not CLOSING[c] for c in range(256)])


def shapes(words: Words) -> np.ndarray:
    """The shape class of each word, from its bytes alone."""
    ends = words.begins + words.sizes

    def some(of: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(of[words.data], dtype=np.int64))
        return sums[ends] > sums[words.begins]

    beyond = some(np.arange(256) >= 0x80)
    closing = CLOSING[words.data[ends - 1]] if len(ends) else np.zeros(0, bool)
    return (beyond + 2 * some(DIGIT) + 4 * some(SIGN) + 8 * closing).astype(np.int64)


@dataclass
class Tables:
    """What every worker holds. ``ids`` maps sorted ``hashes`` of clustered words to their numbers."""

    hashes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray  # by number
    size: int
    held: np.ndarray
    held_n: np.ndarray

    @property
    def end(self) -> int:
        return self.size + SHAPES

    @property
    def symbols(self) -> int:
        return self.size + SHAPES + 1

    def symbols_of(self, words: Words) -> np.ndarray:
        """Number of the word if it is clustered, else of its shape."""
        out = self.size + shapes(words)
        if self.size:
            at = np.minimum(np.searchsorted(self.hashes, words.hashes), self.size - 1)
            hit = self.hashes[at] == words.hashes
            out[hit] = self.ids[at[hit]]
        return out

    def counts_of(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of words that are held, else -1."""
        if not len(self.held):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.held, hashes), len(self.held) - 1)
        return np.where(self.held[at] == hashes, self.held_n[at], -1)


def with_ends(symbols: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with the end after each text, the token before each, and the text of each."""
    many = len(bounds) - 1
    tokens = np.insert(symbols, bounds[1:], end)
    text = np.repeat(np.arange(many), np.diff(bounds) + 1)
    return tokens, np.append(end, tokens[:-1])[: len(tokens)], text


def _summed(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, value = np.concatenate(keys), np.concatenate(sums)
    found, inverse = np.unique(key, return_inverse=True)
    return found, np.bincount(inverse, value, len(found)).astype(np.int64)


class Tally:
    """Counts by key that are summed up whenever much has been added."""

    def __init__(self):
        self.keys, self.sums, self.waits, self.held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0

    def add(self, keys: np.ndarray) -> None:
        found, times = np.unique(keys, return_counts=True)
        self.keys.append(found)
        self.sums.append(times)
        self.waits += len(found)
        if self.waits > max(TALLIED, self.held):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        found, sums = _summed(self.keys, self.sums)
        self.keys, self.sums, self.waits, self.held = [found], [sums], 0, len(found)
        return found, sums


def word_counts(training: DataFrame) -> DataFrame:
    """Every word of the training texts: word (hash), shape, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = [Tally() for _ in range(SHAPES)]
        for batch in batches:
            for some in text_slices(batch, "text"):
                words = Words(some.column("text"), lower=True)
                shape = shapes(words)
                for k in np.unique(shape).tolist():
                    tally[k].add(words.hashes[shape == k].view(np.int64))
        for k, own in enumerate(tally):
            found, sums = own.total()
            yield pa.record_batch([pa.array(found), pa.array(np.full(len(found), k, np.int32)), pa.array(sums)], ["word", "shape", "n"])

    partial = training.select("text").mapInArrow(count, COUNTED)
    return partial.groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


def _bin(n: Column) -> Column:
    return F.floor(F.log2(n) * BINS).cast("int")


def _most_frequent(counts: DataFrame, bins: list[tuple[int, int]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and counts above the lowest cut that leaves at most ``most`` words, sorted by word."""
    total, cut = 0, None
    for place, words in sorted(bins, reverse=True):
        if total + words > most:
            break
        total, cut = total + words, place
    if cut is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = counts.where(_bin(F.col("n")) >= cut).select("word", "n").toArrow()
    words, n = table.column("word").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(words)
    return words[order], n[order]


def word_pairs(training: DataFrame, tables: Tables) -> DataFrame:
    """Neighbouring symbols of the training texts: code (before * symbols + after), n."""
    shared = training.sparkSession.sparkContext.broadcast(tables)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, own = Tally(), shared.value
        for batch in batches:
            for some in text_slices(batch, "text"):
                words = Words(some.column("text"), lower=True)
                tokens, before, _ = with_ends(own.symbols_of(words), words.bounds, own.end)
                tally.add(before * own.symbols + tokens)
        found, sums = tally.total()
        for begin in range(0, len(found), 1 << 17):
            yield pa.record_batch([pa.array(found[begin : begin + (1 << 17)]), pa.array(sums[begin : begin + (1 << 17)])], ["code", "n"])

    return training.select("text").mapInArrow(count, PAIRED).groupBy("code").agg(F.sum("n").alias("n"))


def _by_word(pairs: DataFrame, symbols: int) -> DataFrame:
    """A row per symbol with its neighbours on either side, as arrays no longer than ``symbols``."""
    first, second = F.call_function("div", F.col("code"), F.lit(symbols)), F.col("code") % symbols
    both = pairs.select(first.alias("word"), second.alias("other"), "n", F.lit(True).alias("follows")).union(
        pairs.select(second, first, "n", F.lit(False))
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rest = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            keys = rest.column("word").to_numpy()
            heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
            if len(heads) > 1:
                yield rows(rest, heads)
                rest = rest.slice(heads[-1])
        if rest is not None and rest.num_rows:
            yield rows(rest, np.array([0, rest.num_rows]))

    def rows(table: pa.Table, heads: np.ndarray) -> pa.RecordBatch:
        word, other, n, follows = (table.column(c).to_numpy() for c in ("word", "other", "n", "follows"))
        out = []
        for low, high in zip(heads[:-1].tolist(), heads[1:].tolist()):
            after, own, times = follows[low:high], other[low:high], n[low:high]
            out.append((int(word[low]), *(x.tobytes() for side in (after, ~after) for x in (own[side], times[side]))))
        kinds = [pa.int64()] + [pa.binary()] * 4
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in PACKED.split(", ")])

    return both.repartition("word").sortWithinPartitions("word").mapInArrow(pack, PACKED)


def _packed(batch: pa.RecordBatch) -> Iterator[tuple]:
    for word, *parts in zip(*(c.to_pylist() for c in batch.columns)):
        yield (word, *(np.frombuffer(x, np.int64) for x in parts))


def class_pairs(packed: DataFrame, classes: np.ndarray, many: int) -> np.ndarray:
    """How often one class follows another, over all pairs; ``many`` classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((many, many), np.int64)
        for batch in batches:
            for word, after, after_n, _, _ in _packed(batch):
                np.add.at(sums[classes[word]], classes[after], after_n)
        at = np.flatnonzero(sums.ravel())
        yield pa.record_batch([pa.array(at), pa.array(sums.ravel()[at])], ["code", "n"])

    found = packed.mapInArrow(count, PAIRED).groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(many * many, np.int64)
    for row in found:
        out[row["code"]] = row["n"]
    return out.reshape(many, many)


def xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def likelihood(pairs: np.ndarray) -> float:
    """What the classes contribute to the log likelihood of the training texts."""
    return float(xlogx(pairs).sum() - xlogx(pairs.sum(0)).sum() - xlogx(pairs.sum(1)).sum())


def best_class(pairs: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, twice: int) -> int:
    """The class among the first ``CLASSES`` that makes the texts most likely for one word.

    ``after`` and ``before`` count the classes of its other neighbours, ``twice`` the word next to itself.
    ``pairs`` still counts the word in class ``own``.
    """
    left = pairs.copy()
    left[own] -= after
    left[:, own] -= before
    left[own, own] -= twice
    base = xlogx(left)
    gain = (xlogx(left[:CLASSES] + after) - base[:CLASSES]).sum(1) + (xlogx(left[:, :CLASSES] + before[:, None]) - base[:, :CLASSES]).sum(0)
    k = np.arange(CLASSES)
    corner = left[k, k]
    gain -= xlogx(corner + after[:CLASSES]) + xlogx(corner + before[:CLASSES]) - 2 * base[k, k]
    gain += xlogx(corner + after[:CLASSES] + before[:CLASSES] + twice) - base[k, k]
    rows, columns = left.sum(1)[:CLASSES], left.sum(0)[:CLASSES]
    gain -= xlogx(rows + after.sum() + twice) - xlogx(rows)
    gain -= xlogx(columns + before.sum() + twice) - xlogx(columns)
    return own if gain[own] >= gain.max() else int(gain.argmax())


def exchange(packed: DataFrame, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all symbols and the class pairs under them.

    A sweep moves words one after the other in each task, over its own copy of the class pairs; the next
    sweep starts from the true ones. The likeliest state is kept, so that moves of tasks that spoil each
    other are not. Symbols without members (shapes, the end) stay where they are.
    """
    many = CLASSES + SHAPES + 1
    start = np.arange(tables.size)
    ranks = np.empty(tables.size, np.int64)
    ranks[np.lexsort((start, -tables.counts))] = start
    classes = np.concatenate((ranks % CLASSES, CLASSES + np.arange(SHAPES + 1)))
    pairs = class_pairs(packed, classes, many)
    best = (likelihood(pairs), classes, pairs)
    for _ in range(SWEEPS):

        def sweep(batches: Iterator[pa.RecordBatch], classes=classes, pairs=pairs) -> Iterator[pa.RecordBatch]:
            now, local, moved = classes.copy(), pairs.copy(), []
            for batch in batches:
                for word, after, after_n, before, before_n in _packed(batch):
                    if word >= tables.size:
                        continue
                    twice = int(after_n[after == word].sum())
                    follow = np.bincount(now[after], after_n, many).astype(np.int64)
                    lead = np.bincount(now[before], before_n, many).astype(np.int64)
                    own = now[word]
                    follow[own] -= twice
                    lead[own] -= twice
                    new = best_class(local, own, follow, lead, twice)
                    if new != own:
                        for at, sign in ((own, -1), (new, 1)):
                            local[at] += sign * follow
                            local[:, at] += sign * lead
                            local[at, at] += sign * twice
                        now[word] = new
                        moved.append((word, new))
            columns = list(zip(*moved)) if moved else [[], []]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["code", "n"])

        classes = classes.copy()
        for row in packed.mapInArrow(sweep, PAIRED).collect():
            classes[row["code"]] = row["n"]
        pairs = class_pairs(packed, classes, many)
        best = max(best, (likelihood(pairs), classes, pairs), key=lambda x: x[0])
    return best[1], best[2]


def joined_classes(training: DataFrame, tables: Tables, classes: np.ndarray, pairs: np.ndarray) -> dict[str, np.ndarray]:
    """Words (``hashes``, ``counts``) outside the core with a class for each.

    Neighbours are counted by class, a word's rows meet in one task by key, at most two for each class, and
    the class is the one with the most log-likelihood of the neighbours on both sides and of the word in it.
    The result has a line per held word at most.
    """
    rare = ~np.isin(tables.held, tables.hashes) & (tables.held_n >= LEAST_CLASSED)
    words, n = tables.held[rare], tables.held_n[rare]
    many = CLASSES + SHAPES + 1
    smooth = pairs + TRANSITION
    steps = np.log(smooth / smooth.sum(1, keepdims=True))
    # What a neighbour's class says for each class: those after the word, then those before it.
    says = np.concatenate((steps[:CLASSES], steps[:, :CLASSES].T), axis=1)
    size = -np.log(np.bincount(classes[: tables.size], tables.counts, CLASSES) + 1.0)
    spark = training.sparkSession
    shared = spark.sparkContext.broadcast((tables, classes, words))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of, sought = shared.value
        tally = Tally()
        for batch in batches:
            for some in text_slices(batch, "text"):
                spelled = Words(some.column("text"), lower=True)
                kinds = of[own.symbols_of(spelled)]
                tokens, before, _ = with_ends(kinds, spelled.bounds, of[own.end])
                at = np.arange(len(kinds)) + np.repeat(np.arange(len(spelled.bounds) - 1), np.diff(spelled.bounds))
                place = np.minimum(np.searchsorted(sought, spelled.hashes), max(len(sought) - 1, 0))
                hit = np.flatnonzero(sought[place] == spelled.hashes) if len(sought) else np.zeros(0, np.int64)
                base = place[hit] * (2 * many)
                tally.add(np.concatenate((base + tokens[at[hit] + 1], base + many + before[at[hit]])))
                if tally.held + tally.waits > 2 * TALLIED:
                    yield from rows_of(tally)
                    tally = Tally()
        yield from rows_of(tally)

    def rows_of(tally: Tally) -> Iterator[pa.RecordBatch]:
        found, sums = tally.total()
        for begin in range(0, len(found), 1 << 17):
            yield pa.record_batch([pa.array(found[begin : begin + (1 << 17)]), pa.array(sums[begin : begin + (1 << 17)])], ["code", "n"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns])
            rows = rows if held is None else np.concatenate((held, rows), axis=1)
            word = rows[0] // (2 * many)
            last = np.searchsorted(word, word[-1]) if len(word) else 0
            held = rows[:, last:]
            yield best(rows[:, :last])
        if held is not None:
            yield best(held)

    def best(rows: np.ndarray) -> pa.RecordBatch:
        own, back = np.unique(rows[0] // (2 * many), return_inverse=True)
        near = np.zeros((len(own), 2 * many))
        near[back, rows[0] % (2 * many)] = rows[1]
        found = (near @ says.T + near.sum(1, keepdims=True) / 2 * size).argmax(1) if len(own) else own
        return pa.record_batch([pa.array(own), pa.array(found.astype(np.int64))], ["code", "n"])

    counted = training.select("text").mapInArrow(count, PAIRED).groupBy("code").agg(F.sum("n").alias("n"))
    word = F.call_function("div", F.col("code"), F.lit(2 * many))
    dealt = counted.withColumn("word", word).repartition("word").sortWithinPartitions("code").select("code", "n")
    chosen = stored(dealt.mapInArrow(choose, PAIRED), "word-classes").toArrow()
    found = np.zeros(len(words), np.int64)
    found[chosen.column("code").to_numpy()] = chosen.column("n").to_numpy()
    return {"hashes": words, "counts": n, "classes": found}


def class_transitions(training: DataFrame, tables: Tables, classes: np.ndarray) -> np.ndarray:
    """How often one class follows another in all texts."""
    many = CLASSES + SHAPES + 1
    shared = training.sparkSession.sparkContext.broadcast((tables, classes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, (own, of) = np.zeros(many * many, np.int64), shared.value
        for batch in batches:
            for some in text_slices(batch, "text"):
                words = Words(some.column("text"), lower=True)
                tokens, before, _ = with_ends(of[own.symbols_of(words)], words.bounds, of[own.end])
                sums += np.bincount(before * many + tokens, minlength=many * many)
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at), pa.array(sums[at])], ["code", "n"])

    out = np.zeros(many * many, np.int64)
    for row in training.select("text").mapInArrow(count, PAIRED).groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[row["code"]] = row["n"]
    return out.reshape(many, many)


@dataclass
class Model:
    """A fitted model: tables for workers, log10 probabilities, and all word counts as a table."""

    tables: Tables
    classes: np.ndarray
    transitions: np.ndarray  # log10 P(class | class before)
    members: np.ndarray  # log10 P(symbol | class), 0 for shapes
    shape_total: np.ndarray  # counts in a shape and its unknown words
    shape_unknown: np.ndarray  # what one of its unknown words counts as
    counts: DataFrame
    tokens: int
    types: int
    documents: int


def fit(training: DataFrame) -> Model:
    """A model of all texts of a table (column text; null as empty)."""
    counts = stored(word_counts(training), "word-counts")
    documents = training.count()
    bins, rest = [], np.zeros((SHAPES, 3), np.int64)
    for row in counts.groupBy(_bin(F.col("n")).alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect():
        bins.append((row["bin"], row["words"], row["n"]))
    words, n = _most_frequent(counts, [x[:2] for x in bins], CORE)
    held, held_n = _most_frequent(counts, [x[:2] for x in bins], HELD)
    core = Tables(words, np.arange(len(words)), n, len(words), held, held_n)
    packed = stored(_by_word(word_pairs(training, core), core.symbols), "word-pairs")
    classes, pairs = exchange(packed, core)
    more = joined_classes(training, core, classes, pairs)
    words, n = np.append(words, more["hashes"]), np.append(n, more["counts"])
    classes = np.concatenate((classes[: core.size], more["classes"], CLASSES + np.arange(SHAPES + 1)))
    order = np.argsort(words)
    tables = Tables(words[order], order, n, len(words), held, held_n)
    pairs = class_transitions(training, tables, classes)
    least = int(n.min()) if len(n) else None
    rare = counts.where(F.col("n") < least) if least is not None else counts
    times = [F.sum((F.col("n") == k).cast("bigint")).alias(f"n{k}") for k in (1, 2)]
    for row in rare.groupBy("shape").agg(F.sum("n").alias("n"), *times).collect():
        rest[row["shape"]] = row["n"], row["n1"], row["n2"]
    smooth = pairs + TRANSITION
    transitions = np.log10(smooth / smooth.sum(1, keepdims=True))
    own = np.bincount(classes[: tables.size], tables.counts, CLASSES)
    members = np.zeros(tables.symbols)
    members[: tables.size] = np.log10(tables.counts / own[classes[: tables.size]])
    reserved = rest[:, 1] + 1
    # As many unseen words as there seem to be, but no fewer than make each of them as rare as one seen once.
    unseen = np.maximum(rest[:, 1] * (rest[:, 1] - 1) / (2 * (rest[:, 2] + 1)), reserved)
    return Model(
        tables,
        classes,
        transitions,
        members,
        rest[:, 0] + reserved,
        reserved / unseen,
        counts,
        sum(x[2] for x in bins) + documents,
        sum(x[1] for x in bins) + (1 if documents else 0),
        documents,
    )


PARTS = "n_tokens bigint, n_known bigint, base_score double, score double, rare array<struct<word:bigint,shape:int,times:bigint>>"
SUMS = ["n_tokens", "n_known", "base_score", "score", "rare"]


def _parts(texts: pa.Array, model: Model) -> list[pa.Array]:
    """Sums over the tokens whose counts are held, and the other words of each text with their numbers."""
    tables, many = model.tables, len(texts)
    words = Words(texts, lower=True)
    symbols = tables.symbols_of(words)
    tokens, before, text = with_ends(symbols, words.bounds, tables.end)
    steps = model.transitions[model.classes[before], model.classes[tokens]] + model.members[tokens]
    score = np.bincount(text, steps, many)
    spread = math.log10(model.tokens + model.types + 1)
    base = np.full(many, math.log10(model.documents + 1) - spread)
    doc = np.repeat(np.arange(many), np.diff(words.bounds))
    clustered = symbols < tables.size
    n = np.full(len(symbols), -1, np.int64)
    n[clustered] = tables.counts[symbols[clustered]]
    n[~clustered] = tables.counts_of(words.hashes[~clustered])
    known = n >= 0
    base += np.bincount(doc[known], np.log10(n[known] + 1.0) - spread, many)
    n_known = np.bincount(doc[known], minlength=many) + (1 if model.documents else 0)
    shaped = known & ~clustered
    shape = symbols[shaped] - tables.size
    score += np.bincount(doc[shaped], np.log10(n[shaped] / model.shape_total[shape]), many)
    open_doc, open_word, open_shape = doc[~known], words.hashes[~known].view(np.int64), symbols[~known] - tables.size
    order = np.lexsort((open_word, open_doc))
    open_doc, open_word, open_shape = open_doc[order], open_word[order], open_shape[order]
    fresh = np.append(True, (open_doc[1:] != open_doc[:-1]) | (open_word[1:] != open_word[:-1]))[: len(order)]
    heads = np.flatnonzero(fresh)
    times = np.diff(np.append(heads, len(order)))
    ends = np.searchsorted(open_doc[heads], np.arange(many + 1)).astype(np.int32)
    rows = pa.StructArray.from_arrays([pa.array(open_word[heads]), pa.array(open_shape[heads].astype(np.int32)), pa.array(times)], ["word", "shape", "times"])
    rare = pa.ListArray.from_arrays(pa.array(ends), rows)
    return [pa.array(np.diff(words.bounds) + 1), pa.array(n_known), pa.array(base), pa.array(score), rare]


def score(documents: DataFrame, model: Model) -> DataFrame:
    """All rows and columns but the text, with n_tokens, n_known, train_tokens, base_score, score, perplexity.

    A null text is an empty one: its only token is the end. ``base_score`` is the add-one unigram score.
    Unknown words of a shape share the probability that its words seen once suggest, by their estimated
    number. Repeated rows and nulls
    elsewhere do not matter; an empty training table makes every class equally likely. Input columns of the
    result's names are replaced.
    """
    results = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    own = documents.drop(*results, "rare", "_row")
    passed = [c for c in own.columns if c != "text"]
    plain = own.select(*passed)
    shared = documents.sparkSession.sparkContext.broadcast(
        Model(*(None if k == "counts" else v for k, v in vars(model).items()))
    )

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, "text"):
                columns = [some.column(c) for c in passed] + _parts(some.column("text"), shared.value)
                yield pa.record_batch(columns, [*passed, *SUMS])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    kept = own.mapInArrow(parts, f"{schema}, {PARTS}" if passed else PARTS).withColumn("_row", F.monotonically_increasing_id())
    kept = stored(kept, "score-parts")
    words = kept.select("_row", F.explode("rare").alias("_r")).select("_row", "_r.word", "_r.shape", "_r.times")
    joined = words.join(model.counts.select("word", "n"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total, unknown = (F.element_at(F.array(*map(F.lit, x.tolist())), F.col("shape") + 1) for x in (model.shape_total, model.shape_unknown))
    spread = math.log10(model.tokens + model.types + 1)
    sums = joined.groupBy("_row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known"),
        F.sum(F.col("times") * (F.log10(F.col("n") + 1.0) - spread)).alias("_base"),
        F.sum(F.col("times") * F.log10(F.when(F.col("n") > 0, F.col("n")).otherwise(unknown) / total)).alias("_score"),
    )
    whole = kept.drop("rare").join(sums, "_row", "left")
    for column, part in (("n_known", "_known"), ("base_score", "_base"), ("score", "_score")):
        whole = whole.withColumn(column, F.col(column) + F.coalesce(part, F.lit(0)))
    whole = whole.withColumn("train_tokens", F.lit(model.tokens).cast("bigint"))
    whole = whole.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    return whole.select(*passed, *results)


def held_out() -> Column:
    """Whether a document stays out of the training: crc32 of its id as text leaves 2 by 7."""
    return crc32_of_id() % 7 == 2


def scored_documents(documents: DataFrame) -> DataFrame:
    """Every document with its scores; the model learns from those not held out."""
    small_batches(documents.sparkSession)
    rows = documents.select("doc_id", held_out().alias("held_out"), "text")
    model = fit(rows.where("NOT held_out").select("text"))
    found = score(rows, model)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
