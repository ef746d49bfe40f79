"""How far the sources of a language differ, term by term and pair by pair, by bitmaps of counts.

Within a language every term gets a bit, and a group (language, source) stores one bitset per count: the
terms that it has so often. A bitset is kept as its non-empty 64-bit words. A probability depends on a group
and a count only, so what two sources differ by is a sum over cells (count here, count there): the AND of
two bitsets and its population count give the terms of a cell, which are multiplied by the cell's value f.
Count 0 has no bitset; its cells follow by complement from the sizes of the others. All of it is whole
numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from msgsearch.llm.common import text_slices
from msgsearch.session import stored

# Documents that a term must be in, the scale of probabilities, ranks shown of terms.
LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
SHOWN = 200
#: Stretches that a language's terms are dealt to, for each partition of the session.
STRETCHES = 4
#: Text bytes that one pass holds; a longer text extends the pass.
SLICE = 1 << 23
IS_TERM = np.zeros(256, bool)
IS_TERM[0x80:] = IS_TERM[ord("A") : ord("Z") + 1] = IS_TERM[ord("a") : ord("z") + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
GROUP = ["lang", "source"]


def terms_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of a batch of texts, as codes into its different terms, and the text of each."""
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(raw.buffers()[2], np.uint8, high)[low:] if high > low else np.zeros(0, np.uint8)
    offsets = offsets - low
    solid = np.zeros(len(data) + 1, bool)
    solid[:-1] = IS_TERM[data]
    # A term begins behind another byte or at the start of a text.
    opens = solid[:-1].copy()
    opens[1:] &= ~solid[:-2]
    edges = offsets[:-1][np.diff(offsets) > 0]
    opens[edges] = solid[edges]
    begins = np.flatnonzero(opens)
    kept = LOWER[data[solid[:-1]]]
    # Where each term begins among the kept bytes.
    gaps = np.cumsum(~solid[:-1], dtype=np.int64)
    starts = begins - gaps[begins]
    ends = np.append(starts, len(kept))
    spelled = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
    return spelled.dictionary_encode(), np.searchsorted(offsets, begins, "right") - 1


def _count_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of a slice of documents; every group has a row with a null term."""
    coded, text = terms_of(batch.column("text"))
    codes, many = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
    names = pa.StructArray.from_arrays([batch.column(c) for c in GROUP], GROUP)
    keys: dict[tuple, int] = {}
    group = np.array([keys.setdefault(tuple(x.values()), len(keys)) for x in names.to_pylist()], np.int64)
    in_text, n = np.unique(text * many + codes, return_counts=True)
    place = group[in_text // many] * many + in_text % many
    pairs, back = np.unique(place, return_inverse=True)
    sums = np.zeros(len(pairs), np.int64)
    np.add.at(sums, back, n)
    docs = np.bincount(back, minlength=len(pairs))
    langs, sources = zip(*keys)
    owner = np.append(pairs // many, np.arange(len(keys)))
    spelled = coded.dictionary.take(pa.array(pairs % many)).cast(pa.large_string()).cast(pa.string())
    columns = [pa.array(langs, pa.string()).take(pa.array(owner)), pa.array(sources, pa.string()).take(pa.array(owner))]
    columns.append(pa.concat_arrays([spelled, pa.nulls(len(keys), pa.string())]))
    columns += [pa.array(np.append(x, np.zeros(len(keys), np.int64)).astype(np.int64)) for x in (sums, docs)]
    return pa.record_batch(columns, [*GROUP, "term", "n", "docs"])


def counted(documents: DataFrame) -> DataFrame:
    """(lang, source, stretch, term, n, docs): occurrences and documents of each term of each group.

    A null term marks a group. Terms are dealt to stretches, by hash; all rows of a stretch of a language
    share a partition. There are a few stretches for each partition of the session, so none is large, also
    where one language has most of the rows, and a term has at most one row for each slice and source.
    """
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in (*GROUP, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, "text", SLICE):
                yield _count_slice(some)

    rows = documents.select(*blank).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    stretches = STRETCHES * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("stretch", F.pmod(F.xxhash64("term"), F.lit(stretches)).cast("int")).repartition("lang", "stretch")
    return rows.groupBy("lang", "stretch", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def numbered_terms(counts: DataFrame) -> DataFrame:
    """The kept terms of :func:`counted` with ``lang_n``, ``id`` (their number in the stretch, from 0) and
    ``first`` (1 in one row for each term of a language); the rows of groups stay.

    The windows hold a term, and a stretch of a language; the partitions of the counts serve both.
    """
    term = Window.partitionBy("lang", "stretch", "term")
    sums = counts.withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term)})
    kept = sums.where(F.col("term").isNull() | (F.col("lang_docs") >= LEAST_DOCUMENTS)).drop("docs", "lang_docs")
    order = Window.partitionBy("lang", "stretch").orderBy("term")
    kept = kept.withColumn("id", F.dense_rank().over(order) - 1)
    lone = F.row_number().over(Window.partitionBy("lang", "stretch", "term").orderBy("source"))
    return kept.withColumn("first", F.when(F.col("term").isNotNull() & (lone == 1), 1).otherwise(0))


def probability(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + vocabulary)), exact at any count."""
    among = total + vocabulary
    short = F.call_function("div", (count + 1) * SCALE, among)
    wide = (count.cast("decimal(20,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)")
    long = F.call_function("div", wide, among.cast("decimal(20,0)"))
    return F.when(count < F.lit((1 << 63) // SCALE - 1), short).otherwise(long) + F.lit(1).cast("bigint")


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); at most about 10^18."""
    return F.call_function("div", (p - q) * (p - q), q)


def bitmaps(kept: DataFrame) -> DataFrame:
    """(lang, stretch, source, n, word, bits): the non-empty words of each group's bitset per count."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("id") % 64)
    words = kept.groupBy("lang", "stretch", "source", "n", F.shiftright("id", 6).alias("word"))
    return words.agg(F.bit_or(bit).alias("bits"))


def f_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = p - q
    return ((apart * apart).view(np.uint64) // q.view(np.uint64)).view(np.int64)


def joint_cells(p: np.ndarray, zero: np.ndarray, source: np.ndarray, word: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What joint cells add for ordered pairs of sources: first, second, value, each pair once.

    Arrays are sorted by word. A term in cell (a, b) leaves the cells (a, 0), (0, b) and adds to (0, 0)
    again, so a cell's factor is f(a, b) - f(a, 0) - f(0, b) + f(0, 0).
    """
    many = int(source.max()) + 1 if len(source) else 1
    keys, values, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    edges = np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(word))
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        own = bits[low:high]
        common = np.bitwise_count(own[:, None] & own[None, :])
        i, j = np.nonzero(common)
        other = source[low + i] != source[low + j]
        i, j = i[other], j[other]
        a, b = low + i, low + j
        factor = f_of(p[a], p[b]) - f_of(p[a], zero[b]) - f_of(zero[a], p[b]) + f_of(zero[a], zero[b])
        keys.append(source[a] * many + source[b])
        values.append(common[i, j] * factor)
        held += len(i)
        if held > 1 << 20:
            keys, values = map(list, zip(_summed(keys, values)))
            held = 0
    key, value = _summed(keys, values)
    return key // many, key % many, value


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(key), np.int64)
    np.add.at(sums, back, np.concatenate(values))
    return key, sums


def _joint(table: pa.Table) -> pa.Table:
    """One stretch of a language: bitmaps in, summed values of pairs of sources out."""
    table = table.sort_by("word")
    coded = table.column("source").combine_chunks().dictionary_encode()
    p, zero, word, bits = (table.column(c).to_numpy() for c in ("p", "zero", "word", "bits"))
    first, second, value = joint_cells(p, zero, coded.indices.to_numpy().astype(np.int64), word, bits.view(np.uint64))
    names = coded.dictionary
    lang = pa.repeat(table.column("lang")[0], len(value))
    columns = [lang, names.take(pa.array(first)), names.take(pa.array(second)), pa.array(value)]
    return pa.table(columns, ["lang", "source", "item", "value"])


def audit(documents: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank of every group, for pairs of sources and for terms.

    Null text, lang and source count as ''. A term is kept in a language if at least ``LEAST_DOCUMENTS`` of
    its documents (rows, repeated ones each) hold it. Part ``pair`` has every other source of the language
    with the sum of f over all kept terms, 0 if there are none; part ``term`` the kept terms that a group has
    and gives more to than its language does, down to rank ``SHOWN``. Equal values are ranked by item in
    UTF-8 order. Only lang, source and text are read; a very long text needs a small multiple of its own size;
    an empty table gives an empty result.
    """
    rows = stored(numbered_terms(counted(documents)), "kept-terms")
    kept = rows.where("term IS NOT NULL")
    # A line for each group and language, so these tables are as short as the result has sources.
    totals = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    vocabulary = kept.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("n").alias("lang_total"))
    groups = rows.where("term IS NULL").select(*GROUP).join(totals, GROUP, "left").join(vocabulary, "lang", "left")
    none = F.lit(0).cast("bigint")
    groups = groups.select(*GROUP, *(F.coalesce(c, none).alias(c) for c in ("total", "v", "lang_total")))
    groups = groups.withColumn("zero", F.when(F.col("v") > 0, probability(none, F.col("total"), F.col("v"))))
    groups = stored(groups, "sources")
    return _pairs(kept, groups).unionByName(_terms(kept, groups))


def _with_p(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups, GROUP).withColumn("p", probability(F.col("n"), F.col("total"), F.col("v")))


def _terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    q = probability(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    above = _with_p(kept, groups).withColumn("q", q).where("p > q")
    above = above.select(*GROUP, F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    return _ranked(above, "term").where(F.col("rank") <= SHOWN)


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Values of all ordered pairs of sources of a language, which the result has in full."""
    maps = stored(bitmaps(kept), "count-bitmaps")
    joint = _with_p(maps, groups).select("lang", "stretch", "source", "p", "zero", "word", "bits").groupBy("lang", "stretch")
    joint = joint.applyInArrow(_joint, "lang string, source string, item string, value bigint")
    # The sizes of the bitsets give all cells with a 0, as if no term were common to two sources.
    levels = maps.groupBy(*GROUP, "n").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("many"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    alone = _with_p(levels, groups).join(other, "lang").where("source <> item")
    nothing = distance(F.col("zero"), F.col("other"))
    first = (F.sum(F.col("many") * (distance(F.col("p"), F.col("other")) - nothing))).alias("value")
    first = alone.groupBy(*GROUP, "item").agg(first)
    swapped = distance(F.col("other"), F.col("p")) - distance(F.col("other"), F.col("zero"))
    second = alone.groupBy("lang", F.col("item").alias("source"), F.col("source").alias("item"))
    second = second.agg(F.sum(F.col("many") * swapped).alias("value"))
    empty = groups.join(other, "lang").where("source <> item")
    empty = empty.select(*GROUP, "item", F.coalesce(F.col("v") * nothing, F.lit(0).cast("bigint")).alias("value"))
    parts = joint.unionByName(first).unionByName(second).unionByName(empty)
    return _ranked(parts.groupBy(*GROUP, "item").agg(F.sum("value").alias("value")), "pair")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), F.asc("item"))
    return rows.select(*GROUP, F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
