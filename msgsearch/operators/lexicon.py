"""Dictionary words inside runs of ideographs.

Reading a run from the left, the longest word of the dictionary that begins at a place is taken, else the
single ideograph. Words inside a taken word are terms of a document too (not of a query), so a document with
a long word is found by its parts, but not by characters that only happen to stand side by side.

A dictionary of checked size is sent to the workers, which run an automaton over each text; rows are neither
moved nor multiplied. A larger one meets the substrings of the texts by key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text

# A dictionary within these bounds is sent to every worker.
MAX_WORDS = 1_000_000
MAX_CHARS = 5_000_000
# Bytes of texts that are cut at once; each may become a word, and a longer text is a batch of its own.
SLICE = 1 << 18
# Words of the index and words that a query needs.
PIECES = T.StructType([T.StructField(name, T.ArrayType(T.StringType())) for name in ("words", "inner")])

_FOUND = Iterable[tuple[int, int]]


@dataclass(frozen=True)
class Lexicon:
    """The usable words of a dictionary; ``held`` is None where they are too many to be sent."""

    words: DataFrame
    held: Any = None

    @classmethod
    def of(cls, words: DataFrame) -> Lexicon:
        """From a table with a column ``word``.

        Words have two or more ideographs and nothing else; other rows, nulls and repeats do not count, nor
        do other columns. Without any word, every ideograph is a term by itself.
        """
        usable = words.select("word").filter(F.col("word").rlike(f"^{text.CJK}{{2,}}$")).distinct()
        size = usable.limit(MAX_WORDS + 1).agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
        if size[0] > MAX_WORDS or size[1] > MAX_CHARS:
            return cls(usable)
        held = [row.word for row in usable.collect()]
        return cls(usable, words.sparkSession.sparkContext.broadcast(held))

    def with_index_terms(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Add ``<column>_terms`` for each text column: all terms, repeats included; empty for a null text."""
        return self._with_terms(
            rows, columns, lambda of, p: text.tokens(of, p["words"], p["inner"]), F.array().cast("array<string>")
        )

    def with_query_terms(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Add ``<column>_terms`` for each text column: the distinct terms that a document must contain."""
        return self._with_terms(rows, columns, lambda of, p: F.array_distinct(text.tokens(of, p["words"])), F.lit(None))

    def _with_terms(self, rows: DataFrame, columns, terms, missing: Column) -> DataFrame:
        cut = reduce(self._with_pieces, columns, rows)
        named = {f"{c}_terms": F.coalesce(terms(F.col(c), F.col(f"{c}_pieces")), missing) for c in columns}
        return cut.withColumns(named).drop(*[f"{c}_pieces" for c in columns])

    def _with_pieces(self, rows: DataFrame, column: str) -> DataFrame:
        into = f"{column}_pieces"
        if self.held is not None:
            return rows.withColumn(into, _automaton(self.held)(column))
        key = F.sha2(F.col(column), 256)
        found = self._found(rows.select(key.alias("key"), F.col(column).alias("value")))
        joined = rows.withColumn("_key", key).join(found.withColumnRenamed("key", "_key"), "_key", "left")
        none = F.array().cast("array<int>")
        places, sizes = (F.coalesce(c, none) for c in ("_places", "_sizes"))
        return joined.withColumn(into, _given(F.col(column), places, sizes)).drop("_key", "_places", "_sizes")

    def _found(self, texts: DataFrame) -> DataFrame:
        """``key, _places, _sizes``: where words of the dictionary lie in each different text.

        From each place, the ideographs up to the longest word go on with the text's key only, so long texts
        are not repeated. What is gathered for a text is bounded by its own length.
        """
        longest = self.words.agg(F.max(F.length("word"))).first()[0]
        # One element per code point, as the places count them.
        letters = F.regexp_extract_all("value", F.lit("(?s)."), F.lit(0)).alias("letters")
        window = F.transform("letters", lambda _, i: F.array_join(F.slice(F.col("letters"), i + 1, longest), ""))
        ideographs = texts.filter(F.col("value").rlike(text.CJK)).dropDuplicates(["key"])
        windows = ideographs.select("key", letters).select("key", F.posexplode(window).alias("place", "window"))
        runs = windows.withColumn("run", F.regexp_extract("window", f"^{text.CJK}+", 0)).filter(F.length("run") > 1)
        sizes = F.explode(F.sequence(F.lit(2), F.length("run")))
        spans = runs.select("key", "place", "run", sizes.alias("size"))
        spans = spans.select("key", "place", "size", F.expr("left(run, size)").alias("word"))
        matched = spans.join(self.words, "word").groupBy("key").agg(F.collect_list(F.struct("place", "size")).alias("all"))
        return matched.select("key", F.col("all.place").alias("_places"), F.col("all.size").alias("_sizes"))


def pieces(value: str, found: _FOUND) -> tuple[list[str], list[str]]:
    """Words and lone ideographs of a text in order, and the words inside its words.

    ``found`` has place and size of every occurrence of a dictionary word, in any order.
    """
    words: list[str] = []
    inner: list[str] = []
    end = 0
    for place, size in sorted(found, key=lambda x: (x[0], -x[1])):
        if place >= end:
            words += filter(_ideograph, value[end:place])
            end = place + size
            words.append(value[place:end])
        elif place + size <= end:
            inner.append(value[place : place + size])
    words += filter(_ideograph, value[end:])
    return words, inner


def _ideograph(letter: str) -> bool:
    return "一" <= letter <= "鿿"


_CUT = pa.struct([pa.field(name, pa.list_(pa.string())) for name in ("words", "inner")])


def _slices(texts: pa.Array, *more: pa.Array) -> Iterator[list[pa.Array]]:
    """Arrays of the same rows in stretches of about ``SLICE`` bytes of the texts."""
    begin = size = 0
    for end, one in enumerate(pc.binary_length(texts).fill_null(0).to_pylist(), 1):
        size += one
        if size >= SLICE or end == len(texts):
            yield [x.slice(begin, end - begin) for x in (texts, *more)]
            begin, size = end, 0


def _struct(cut: Iterable[tuple[list[str], list[str]]]) -> pa.Array:
    words, inner = zip(*cut)
    return pa.StructArray.from_arrays([pa.array(c, pa.list_(pa.string())) for c in (words, inner)], fields=list(_CUT))


def _automaton(held):
    @F.arrow_udf(PIECES)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick  # only where a dictionary is used

        known = ahocorasick.Automaton()
        for word in held.value:
            known.add_word(word, len(word))
        known.make_automaton()

        def found(value: str) -> _FOUND:
            return [(last - size + 1, size) for last, size in known.iter(value)] if len(known) else []

        for batch in batches:
            if not len(batch):
                yield pa.array([], _CUT)
            for (some,) in _slices(batch):
                yield _struct(pieces(v, found(v)) if v else ([], []) for v in some.to_pylist())

    return cut


@F.arrow_udf(PIECES)
def _given(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for batch in batches:
        if not len(batch[0]):
            yield pa.array([], _CUT)
        for some in _slices(*batch):
            values, places, sizes = (x.to_pylist() for x in some)
            yield _struct(pieces(v or "", zip(p, s)) for v, p, s in zip(values, places, sizes))
