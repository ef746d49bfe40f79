"""A table of searches of any size, against one pass over the postings.

Documents are dealt to shares by their keys and searches by their ids, and each pair of shares is a cell: all
postings of a document and all clauses of a search meet in one cell of a pair, however often a term occurs. The
weight of a posting does not depend on the search, so a cell adds up the weights of the postings that a search
names, document by document in one array, and only its best for each search travel on. No row is made for a
search and a document that have a term in common.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..operators import matching
from ..operators.postings import KEY
from ..operators.topk import top_k
from ..session import stored
from ..sources import corpus as corpora

# Postings, or clauses, of a cell. A worker holds about 100 bytes for each.
CELL_ROWS = 1_000_000
# Cells for each core that the session knows of, at least.
CELLS_PER_CORE = 3

_BEST = "search_id string, id string, micro bigint"


def grid_search(corpus, searches: DataFrame, limit: int, order: list, match: str = "any") -> DataFrame:
    """``search_id, id, micro`` of the best documents of each search, stored.

    ``order`` is by falling ``micro``, then ``id``.
    """
    wanted = matching.clauses(searches, corpus.lexicon)
    wanted = stored(matching.with_needed(wanted) if match == "all" else wanted, "clauses")
    found, frequencies = corpus.placed(matching.vocabulary(wanted))
    weights = matching.term_weights(frequencies, corpus.field_stats(), "df")
    weights = stored(weights.withColumn("term_no", F.monotonically_increasing_id()), "weights")
    postings = weights.agg(F.sum("df")).first()[0] or 0
    by_share, by_ask = _shares(searches, postings, wanted.count())
    share = F.pmod(F.xxhash64(*KEY), F.lit(by_share))
    ask = F.pmod(F.xxhash64("search_id"), F.lit(by_ask))

    rows = _with_terms(found, weights, postings)
    rows = rows.select(share.alias("share"), "term_no", *KEY, "sender_id", matching.weight().alias("micro"))
    rows = rows.withColumn("cell", F.explode(_numbers(F.col("share") * by_ask, by_ask))).drop("share")
    numbers = weights.select("field", "term", "df", F.col("term_no").alias("named_no"))
    asked = _with_terms(wanted, numbers, postings).drop("term", "df")
    asked = asked.withColumn("cell", F.explode(_numbers(ask, by_share, by_ask)))
    scored = rows.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(_scorer(limit, match), _BEST)
    return stored(top_k(scored, ["search_id"], order, limit, "id").drop("position"), "best")


def _numbers(first, many: int, step: int = 1):
    first = first.cast("bigint")
    return F.sequence(first, first + (many - 1) * step, F.lit(step).cast("bigint"))


def _with_terms(rows: DataFrame, weights: DataFrame, postings: int) -> DataFrame:
    """Inner join of postings or clauses with the weights of their terms.

    Of many terms only the frequent ones are sent to every task. The others meet their rows by key, however small
    their compressed file looks to Spark: the driver never holds them, and none has many postings. Clauses of a term
    that only searches have often are split by adaptive execution.
    """
    on = ["field", "term"]
    if weights.limit(corpora.MOST_FREQUENT + 1).count() <= corpora.MOST_FREQUENT:
        return rows.join(weights, on)
    # At most MOST_FREQUENT terms can have this share of all postings.
    frequent = F.col("df") * corpora.MOST_FREQUENT >= F.lit(postings)
    hot = weights.filter(frequent)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(weights.filter(~frequent).hint("merge"), on))


def _shares(searches: DataFrame, postings: int, clauses: int) -> tuple[int, int]:
    """Shares of the documents and of the searches: bounded, enough for all cores, with few copies of rows."""
    cells = CELLS_PER_CORE * searches.sparkSession.sparkContext.defaultParallelism
    by_share = max(1, -(-postings // CELL_ROWS), isqrt(cells * postings // max(1, clauses)))
    return min(by_share, max(cells, -(-postings // CELL_ROWS))), max(1, -(-clauses // CELL_ROWS), -(-cells // by_share))


def _scorer(limit: int, match: str):
    def score(postings: pa.Table, clauses: pa.Table) -> pa.Table:
        if not len(postings) or not len(clauses):
            return _best([], [], [])
        return _Cell(postings).best(clauses, limit, match)

    return score


def _best(searches: list, ids: list, micro: list) -> pa.Table:
    columns = [pa.array(searches, pa.string()), pa.array(ids, pa.string()), pa.array(micro, pa.int64())]
    return pa.table(columns, names=["search_id", "id", "micro"])


def _codes(column) -> np.ndarray:
    """Numbers that are equal where the values are; null is a value."""
    return column.combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


class _Cell:
    """Postings sorted by term, then document; documents are numbered in the order of their ids."""

    def __init__(self, rows: pa.Table):
        code = np.zeros(len(rows), np.int64)
        for name in KEY:
            more = _codes(rows[name])
            code = np.unique(code * (more.max() + 1) + more, return_inverse=True)[1]
        _, first, number = np.unique(code, return_index=True, return_inverse=True)
        keys = rows.select(KEY).take(first)
        parts = [keys[name].cast(pa.string()) for name in KEY]
        # As functions.names.doc_id writes it.
        ids = pc.binary_join_element_wise(*parts, ":", null_handling="skip")
        places = pc.sort_indices(ids).to_numpy()
        self.ids, self.keys = ids.take(places), keys.take(places)
        rank = np.empty(len(places), np.int64)
        rank[places] = np.arange(len(places))
        terms, documents = rows["term_no"].to_numpy(), rank[number]
        order = np.lexsort((documents, terms))
        self.documents, terms = documents[order], terms[order]
        # Sums of whole numbers below 2^53 are exact.
        self.micro = rows["micro"].to_numpy()[order].astype(np.float64)
        self.senders = rows["sender_id"].combine_chunks().take(pa.array(order))
        self.terms, self.begins = np.unique(terms, return_index=True)
        self.ends = np.append(self.begins[1:], len(terms))
        again = np.zeros(len(terms), bool)
        again[1:] = (terms[1:] == terms[:-1]) & (self.documents[1:] == self.documents[:-1])
        self.repeats = np.logical_or.reduceat(again, self.begins)
        self.weightless = bool((self.micro == 0).any())

    def best(self, clauses: pa.Table, limit: int, match: str) -> pa.Table:
        slots = np.searchsorted(self.terms, clauses["named_no"].to_numpy())
        slots[slots == len(self.terms)] = 0
        here = self.terms[slots] == clauses["named_no"].to_numpy()
        clauses, slots = clauses.filter(pa.array(here)), slots[here]
        if not len(clauses):
            return _best([], [], [])
        search, part, field = (_codes(clauses[c]) for c in ("search_id", "part_no", "field"))
        order = np.lexsort((field, part, search))
        clauses, slots = clauses.take(pa.array(order)), slots[order]
        search, part, field = search[order], part[order], field[order]
        whole = clauses["n_terms"].to_numpy()
        begins = np.flatnonzero(np.append(True, search[1:] != search[:-1]))
        heads = clauses.select([c for c in ("search_id", *matching.SCOPE, "needed") if c in clauses.column_names]).take(begins)
        found: tuple[list, list, list] = ([], [], [])
        for head, a, b in zip(heads.to_pylist(), begins, np.append(begins[1:], len(search))):
            sender = head.get("scope_sender_id")
            if match == "any":
                alone = (whole[a:b] == 1) & ~self.repeats[slots[a:b]] & (sender is None)
            else:
                alone = np.zeros(b - a, bool)
            named = [self._rows(s) for s in slots[a:b][alone]]
            rest = np.flatnonzero(~alone) + a
            if len(rest):
                named += self._satisfied(rest, slots, part, field, whole, sender, head.get("needed"))
            if named:
                documents, micro = (np.concatenate(x) for x in zip(*named))
                at, sums = self._top(documents, micro, head, limit)
                found[0].extend([head["search_id"]] * len(at))
                found[1].append(at)
                found[2].append(sums)
        if not found[0]:
            return _best([], [], [])
        ids = self.ids.take(pa.array(np.concatenate(found[1])))
        return _best(found[0], ids.to_pylist(), np.concatenate(found[2]).astype(np.int64))

    def _rows(self, slot: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.begins[slot], self.ends[slot]
        return self.documents[a:b], self.micro[a:b]

    def _satisfied(self, at, slots, part, field, whole, sender, needed) -> list[tuple[np.ndarray, np.ndarray]]:
        """Documents and weights of the clauses whose terms all occur; with ``needed``, of documents with that many parts."""
        found = []
        cuts = np.flatnonzero((part[at][1:] != part[at][:-1]) | (field[at][1:] != field[at][:-1])) + 1
        for clause in np.split(at, cuts):
            rows = np.concatenate([np.arange(self.begins[s], self.ends[s]) for s in slots[clause]])
            if sender is not None:
                rows = rows[pc.equal(self.senders.take(pa.array(rows)), sender).fill_null(False).to_numpy(zero_copy_only=False)]
            documents, inverse, many = np.unique(self.documents[rows], return_inverse=True, return_counts=True)
            kept = many == whole[clause[0]]
            found.append((part[clause[0]], documents[kept], np.bincount(inverse, self.micro[rows], len(documents))[kept]))
        if needed is not None:
            pairs = np.unique(np.concatenate([d * (part.max() + 1) + p for p, d, _ in found])) // (part.max() + 1)
            documents, many = np.unique(pairs, return_counts=True)
            whole_documents = documents[many == needed]
            inside = [np.isin(d, whole_documents) for _, d, _ in found]
            return [(d[i], m[i]) for (_, d, m), i in zip(found, inside)]
        return [(d, m) for _, d, m in found]

    def _top(self, documents: np.ndarray, micro: np.ndarray, head: dict, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The best documents of a search in its scope, by weight and number, and their weights."""
        sums = np.bincount(documents, micro, len(self.ids))
        hit = np.bincount(documents, minlength=len(self.ids)) > 0 if self.weightless else sums > 0
        for name in ("session_name", "chat_id"):
            if head.get(f"scope_{name}") is not None:
                hit &= self._equal(name, head[f"scope_{name}"])
        at = np.flatnonzero(hit)
        if len(at) > limit:
            some = sums[at]
            least = np.partition(some, len(at) - limit)[len(at) - limit]
            more = at[some > least]
            at = np.concatenate([more, at[some == least][: limit - len(more)]])
        return at, sums[at]

    def _equal(self, name: str, value) -> np.ndarray:
        return pc.equal(self.keys[name], value).fill_null(False).to_numpy()
