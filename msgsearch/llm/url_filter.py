"""URL filters: rules first, a ratio of two character models for what no rule decides.

A rule is a host and a path; the longest that fits decides. The URLs that rules allow and those they block
train two variable-order Markov models over bytes. An order's probabilities are interpolated with those of
the next shorter context by the number of different bytes seen behind the context (Witten-Bell), down to an
even spread. Counts cover every URL that a rule decides, outside the hosts held out. Workers hold the most frequent
contexts; the others that a stretch of URLs has are joined to it before it is scored, so every context counts. A URL's
score is the difference of its two log-likelihoods divided by its length, and the border between allowing and blocking
is set on decided URLs of hosts that the models have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from msgsearch.llm.common import text_slices
from msgsearch.session import stored

#: The rules, as (verdict, host and path).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
ALLOW, BLOCK = "allow", "block"
#: Byte strings whose counts workers hold, at most, for all orders together: about 50 bytes each. Others are joined.
HELD = 1 << 21
#: Steps per doubling in which context counts are grouped to find a cut.
BINS = 64
#: Different byte strings that a counting task holds before it sends them on.
TALLIED = 1 << 20
#: Bytes of context, at most.
ORDER = 5
#: One part in so many of the hosts stays out of the fit and sets the border.
HOLD_OUT = 5
#: Scores are rounded to this part of a natural logarithm per byte.
STEPS = 1024
#: Bytes of URLs in a batch, and symbols that are looked up at once.
SLICE = 1 << 20
CHUNK = 1 << 17
# Bytes that no UTF-8 text holds.
BEGIN, END = 0xFE, 0xFF
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for a null or where ``://`` is missing."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    host, path = (F.coalesce(x, F.lit("")) for x in rest)
    return F.translate(host, UPPER, LOWERED), path


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null where none does.

    A rule fits its host and all below it, where the path begins with the rule's. Of equally long rules the
    first in alphabetical order wins. The list is part of the plan, so it is for hundreds, not millions.
    """
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    if found is None:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    return found


class Spelled:
    """The symbols of a batch of strings: each is led by ``ORDER`` begin marks and closed by an end mark."""

    def __init__(self, texts: pa.Array):
        raw = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
        low, high = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(raw.buffers()[2], np.uint8, high)[low:] if high > low else np.zeros(0, np.uint8)
        self.sizes = np.diff(offsets) + 1
        begins = offsets[:-1] - low + np.arange(len(raw)) * (ORDER + 1)
        self.symbols = np.full(len(data) + len(raw) * (ORDER + 1), BEGIN, np.uint8)
        body = np.ones(len(self.symbols), bool)
        for k in range(ORDER):
            body[begins + k] = False
        ends = begins + ORDER + self.sizes - 1
        self.symbols[ends] = END
        self.scored = body.copy()
        self.closes = np.cumsum(self.sizes)
        body[ends] = False
        self.symbols[body] = data

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For some of the strings' bytes and end marks at a time: the number of the string, and the last
        ``ORDER`` + 1 symbols there as one integer, the symbol itself lowest."""
        done = 0
        for begin in range(0, len(self.symbols), CHUNK):
            end = min(begin + CHUNK, len(self.symbols))
            at = np.flatnonzero(self.scored[begin:end]) + begin
            window = np.zeros(len(at), np.uint64)
            for back in range(ORDER, -1, -1):
                window = (window << np.uint64(8)) | self.symbols[at - back]
            owner = np.searchsorted(self.closes, np.arange(done, done + len(at)), "right")
            done += len(at)
            yield owner, window


def _grams(window: np.ndarray, order: int) -> np.ndarray:
    """Keys of the last ``order`` + 1 symbols; keys of different orders differ."""
    return (np.uint64(order + 1) << np.uint64(56)) | (window & np.uint64((1 << 8 * (order + 1)) - 1))


@dataclass
class Models:
    """Per order the seen strings of ``order`` + 1 symbols and their contexts, sorted, with counts for both.

    ``grams[k]`` is (keys, counts) and ``contexts[k]`` is (keys, totals, different symbols); counts have a
    column for allowed and one for blocked URLs. Of orders below ``whole`` all contexts are here. For those that are
    not, ``rest`` has rows (context, key, allowed, blocked); it is None where nothing is missing.
    """

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    whole: int = ORDER + 1
    rest: DataFrame | None = None

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Models:
        """``keys`` as signed integers in any order, one row of ``counts`` each."""
        order = np.argsort(keys)
        keys, counts = keys[order].astype(np.uint64), counts[order]
        grams, contexts = [], []
        for k in range(ORDER + 1):
            low, high = np.searchsorted(keys, [np.uint64(k + 1) << np.uint64(56), np.uint64(k + 2) << np.uint64(56)])
            own, many = keys[low:high], counts[low:high]
            before = own >> np.uint64(8)
            heads = np.flatnonzero(np.diff(before, prepend=before[:1] + np.uint64(1))) if len(own) else np.zeros(0, np.int64)
            totals = np.add.reduceat(many, heads, axis=0) if len(own) else many
            kinds = np.add.reduceat((many > 0).astype(np.int64), heads, axis=0) if len(own) else many
            grams.append((own, many))
            contexts.append((before[heads], totals, kinds))
        return cls(grams, contexts)

    def _seen(self, order: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The counts of some strings, and their contexts' totals and different symbols; 0 where not held."""
        (keys, counts), (contexts, totals, kinds) = self.grams[order], self.contexts[order]
        if not len(keys):
            return (np.zeros((len(own), 2), np.int64),) * 3
        place, hit = _found(keys, own)
        count = np.where(hit[:, None], counts[place], 0)
        place, hit = _found(contexts, own >> np.uint64(8))
        return count, np.where(hit[:, None], totals[place], 0), np.where(hit[:, None], kinds[place], 0)

    def probabilities(self, window: np.ndarray, more: Models | None = None) -> np.ndarray:
        """The probability of the last symbol of each window under both models. ``more`` has contexts not held here."""
        # Any byte or the end mark; the begin mark is never predicted.
        chance = np.full((len(window), 2), 1 / 255)
        for k in range(ORDER + 1):
            own = _grams(window, k)
            count, total, kind = self._seen(k, own)
            if more is not None:
                count, total, kind = (a + b for a, b in zip((count, total, kind), more._seen(k, own)))
            chance = np.where(total > 0, (count + kind * chance) / np.maximum(total + kind, 1), chance)
        return chance

    def scores(self, texts: pa.Array, more: Models | None = None) -> np.ndarray:
        """log P(allowed) - log P(blocked) per symbol, end mark included, in whole ``STEPS`` parts."""
        spelled = Spelled(texts)
        sums = np.zeros(len(texts))
        for owner, window in spelled.chunks():
            kinds, back = np.unique(window, return_inverse=True)
            logs = np.log(self.probabilities(kinds, more))
            # One after the other, so that a sum does not depend on where chunks end.
            np.add.at(sums, owner, (logs[:, 0] - logs[:, 1])[back])
        return np.floor(sums / spelled.sizes * STEPS + 0.5).astype(np.int64)

    def missing(self, texts: pa.Array) -> np.ndarray:
        """Contexts of the texts that are not here and may be in ``rest``.

        What is seen behind a context is seen behind its shorter ones too, so where all contexts of an order are
        here, the longer ones of an unseen one are not looked for.
        """
        asked = [np.zeros(0, np.uint64)]
        for _, window in Spelled(texts).chunks():
            window = np.unique(window)
            for k in range(ORDER + 1):
                context, own = _grams(window, k) >> np.uint64(8), self.contexts[k][0]
                held = _found(own, context)[1] if len(own) else np.zeros(len(context), bool)
                if k < self.whole:
                    window = window[held]
                else:
                    asked.append(np.unique(context[~held]))
        return np.unique(np.concatenate(asked))


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def fit(labelled: DataFrame) -> Models:
    """Models from all different (text, allowed); a text that occurs often is learned once.

    Strings are counted in tasks and summed by key. A context is held with all that was seen behind it or not at
    all: the longest ones go by the lowest count, over both sides, that leaves ``HELD`` strings at most. All contexts
    stay in the models' ``rest`` then, where :func:`scored` looks up those that are not held. Null texts teach nothing.
    """
    known = labelled.where(F.col("text").isNotNull() & F.col("allowed").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for some in text_slices(batch, "text", SLICE):
                side = np.where(some.column("allowed").to_numpy(zero_copy_only=False), 0, 1)
                for owner, window in Spelled(some.column("text")).chunks():
                    keys = np.concatenate([_grams(window, k) for k in range(ORDER + 1)])
                    waits.append(_tally(keys, np.tile(side[owner], ORDER + 1)))
                    held += len(waits[-1])
                    if held > TALLIED:
                        waits = [_merged(waits)]
                        held = len(waits[0])
                        if held > TALLIED // 2:
                            yield from _lines(waits[0])
                            waits, held = [], 0
        if waits:
            yield from _lines(_merged(waits))

    counted = known.select("text", "allowed").distinct().mapInArrow(count, "key bigint, allowed bigint, blocked bigint")
    sums = counted.groupBy("key").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    grams = stored(sums, "url-models")
    context = F.shiftrightunsigned("key", 8).alias("context")
    contexts = stored(
        grams.groupBy(context).agg(F.sum(F.col("allowed") + F.col("blocked")).alias("n"), F.count(F.lit(1)).alias("grams")),
        "url-contexts",
    )
    # The number of a string's symbols stands in its highest byte.
    bins = contexts.groupBy(
        F.shiftrightunsigned("context", 48).alias("symbols"), F.floor(F.log2("n") * BINS).alias("bin")
    ).agg(F.sum("grams").alias("grams"), F.min("n").alias("n"))
    room, least, whole = HELD, {}, ORDER + 1
    for row in sorted(bins.collect(), key=lambda r: (r["symbols"], -r["bin"])):
        if room >= 0:
            room -= row["grams"]
            if room >= 0:
                least[row["symbols"]] = row["n"]
            else:
                whole = row["symbols"] - 1
    kept = [(F.shiftrightunsigned("context", 48) == k) & (F.col("n") >= n) for k, n in least.items()]
    held, rest = grams, None
    if room < 0:
        some = contexts.where(reduce(or_, kept, F.lit(False))).select("context")
        rest = grams.withColumn("context", context)
        held = rest.join(some, "context", "left_semi")
    rows = held.select("key", "allowed", "blocked").toArrow()
    keys, *counts = (rows.column(c).to_numpy() for c in ("key", "allowed", "blocked"))
    return replace(Models.of(keys, np.stack(counts, axis=1)), whole=whole, rest=rest)


def _tally(keys: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Rows of a key and how often each side has it."""
    own, back = np.unique(keys, return_inverse=True)
    return np.stack([own.astype(np.int64), *(np.bincount(back[sides == k], minlength=len(own)) for k in (0, 1))], axis=1)


def _merged(tallies: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(tallies)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    heads = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0])[: len(rows)])
    return np.column_stack([rows[heads, 0], np.add.reduceat(rows[:, 1:], heads, axis=0)]) if len(rows) else rows


def _lines(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    for begin in range(0, len(rows), CHUNK):
        columns = [pa.array(np.ascontiguousarray(c)) for c in rows[begin : begin + CHUNK].T]
        yield pa.record_batch(columns, ["key", "allowed", "blocked"])


def scored(rows: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """All columns with ``steps``: the score of a text in whole parts of ``STEPS``; null counts as empty."""
    shared = rows.sparkSession.sparkContext.broadcast(replace(models, rest=None))
    own = rows.drop("steps")
    names = [*own.columns, "steps"]
    schema = own.withColumn("steps", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, text, SLICE):
                yield pa.record_batch([*some.columns, pa.array(shared.value.scores(some.column(text)))], names)

    if models.rest is None:
        return own.mapInArrow(run, schema)
    cells = _dealt(own, text)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, text, SLICE):
                cell = some.column("_cell").to_numpy()
                begins = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                for begin, end in zip(begins, np.append(begins[1:], len(cell))):
                    asked = shared.value.missing(some.column(text).slice(begin, end - begin)).astype(np.int64)
                    yield pa.record_batch([np.full(len(asked), cell[begin]), asked], ["_cell", "context"])

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        # A context comes again where several tasks have asked for the same cell.
        keys, first = np.unique(found["key"].to_numpy(), return_index=True)
        more = Models.of(keys, np.stack([found[c].to_numpy()[first] for c in ("allowed", "blocked")], axis=1))
        steps = [
            shared.value.scores(some.column(text), more)
            for batch in texts.to_batches()
            for some in text_slices(batch, text, SLICE)
        ]
        return texts.select(names[:-1]).append_column("steps", pa.array(np.concatenate(steps)))

    asked = cells.select(text, "_cell").mapInArrow(ask, "_cell bigint, context bigint")
    # Neither side is as small as its compressed file.
    found = models.rest.join(asked.hint("merge"), "context").select("_cell", "key", "allowed", "blocked")
    return cells.groupBy("_cell").cogroup(found.groupBy("_cell")).applyInArrow(score, schema)


def _dealt(rows: DataFrame, text: str) -> DataFrame:
    """Rows with ``_cell``, the number of a stretch of up to about two ``SLICE`` of text bytes; stored."""
    names = [*rows.columns, "_cell"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for some in text_slices(batch, text, SLICE):
                yield pa.record_batch([*some.columns, np.full(some.num_rows, cell)], names)
                filled += some.column(text).nbytes
                if filled >= SLICE:
                    cell, filled = cell + 1, 0

    schema = rows.withColumn("_cell", F.lit(0).cast("bigint")).schema
    return stored(rows.mapInArrow(deal, schema), "url-cells")


def border(held: DataFrame) -> int:
    """The least score that is allowed, from (steps, allowed) of decided rows outside the fit.

    It makes the sum of the two shares of wrong verdicts least, so a side with more rows weighs no more; of
    equally good borders the nearest to 0, then the smaller. Without rows of both sides it is 0. The
    histogram that reaches the driver has a line per score in ``STEPS`` parts, not per row.
    """
    lines = held.groupBy("steps").agg(F.count_if("allowed").alias("good"), F.count_if(~F.col("allowed")).alias("bad")).orderBy("steps").toArrow()
    steps, good, bad = (np.asarray(lines.column(c).to_numpy(), np.int64) for c in ("steps", "good", "bad"))
    if not good.sum() or not bad.sum():
        return 0
    # Borders: 0, each score, and one beyond the last. What lies below a border is blocked.
    tried = np.unique(np.concatenate([[0], steps, steps[-1:] + 1]))
    below = np.searchsorted(steps, tried)
    lost = np.append(0, np.cumsum(good))[below]
    passed = bad.sum() - np.append(0, np.cumsum(bad))[below]
    # The two shares over their common denominator, as Python integers.
    wrong = [int(a) * int(bad.sum()) + int(b) * int(good.sum()) for a, b in zip(lost, passed)]
    return min(zip(wrong, np.abs(tried).tolist(), tried.tolist()))[2]


def judge(pages: DataFrame, key: str = "page_id", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """The key, host, path, rule and verdict of every row, with ``steps``, the score where no rule fits.

    Models learn from the rows that rules decide, except those of one in ``HOLD_OUT`` hosts, which set the
    border; every row counts for that, repeats included. What the models see is host and path. Rows without
    a fitting rule, a null or malformed URL among them (host and path empty), get the models' verdict. Where
    rules decide nothing, models know nothing, every score is 0 and the verdict is allow. Equal rows get
    equal results; other columns are left behind; an empty table gives an empty one.
    """
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    rows = rows.select("key", "host", "path", "found.*", F.concat("host", "path").alias("text"))
    held = F.pmod(F.xxhash64("host"), F.lit(HOLD_OUT)) == 0
    decided = rows.where("rule IS NOT NULL").withColumn("allowed", F.col("verdict") == ALLOW)
    models = fit(decided.where(~held).select("text", "allowed"))
    # One scoring pass serves the border and the verdicts; rules decide the rest without a score.
    unsure = F.col("rule").isNull() | held
    texts = stored(scored(rows.where(unsure), models), "url-scores")
    least = border(texts.where("rule IS NOT NULL").select("steps", (F.col("verdict") == ALLOW).alias("allowed")))
    by_model = F.when(F.col("steps") >= least, ALLOW).otherwise(BLOCK)
    judged = texts.withColumn("verdict", F.coalesce("verdict", by_model))
    sure = rows.where(~unsure).withColumn("steps", F.lit(None).cast("bigint"))
    both = judged.unionByName(sure)
    shown = F.when(F.col("rule").isNull(), F.col("steps")).alias("steps")
    return both.select(F.col("key").alias(key), "host", "path", "rule", "verdict", shown)


def url_verdicts(pages: DataFrame) -> DataFrame:
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
