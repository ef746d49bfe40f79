"""The best documents of a few searches, reading only slabs that can hold one of them.

The index has the largest weight of each term in each slab, so each slab has a bound for each search. The
slabs with the highest bounds are read first; the k-th best score found there is one that the others must
reach, and those whose bound does not are never read. The result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.literals import any_of
from ..functions.names import doc_id
from ..operators import matching
from ..operators.postings import KEY
from ..operators.topk import top_k
from ..session import stored

# Slabs of each search that are read first, and slabs that are looked up by literals.
FIRST = 4
PUSHED_SLABS = 500
# Postings of the wanted terms from which bounds pay, and searches up to which they are worked out.
LEAST_POSTINGS = 1_000_000
MOST_SEARCHES = 50


def skipping_search(
    corpus,
    wanted: DataFrame,
    asked: list,
    limit: int,
    order: list,
    match: str = "any",
    least_postings: int = LEAST_POSTINGS,
) -> DataFrame | None:
    """``search_id, id, micro`` of the best documents; None where skipping does not pay.

    ``wanted`` is of checked size, and ``asked`` are its different terms and scopes. At most ``MOST_SEARCHES`` times ``FIRST`` slabs are named on the driver
    at first, and up to ``PUSHED_SLABS`` after that; more are joined.
    """
    named = any_of("term", {a.term for a in asked})
    many = corpus.index.term_stats().filter(named).agg(F.sum("df")).first()[0] or 0
    if many < least_postings or wanted.select("search_id").distinct().count() > MOST_SEARCHES:
        return None
    found, weights = corpus.lookup(wanted, True, asked)
    weights = stored(weights, "weights")
    tops = corpus.pushed(corpus.term_slabs(), wanted, asked)
    bounds = stored(matching.slab_bounds(tops, wanted, weights), "bounds")

    def best(slabs: DataFrame) -> DataFrame:
        names = [r.slab for r in slabs.select("slab").distinct().limit(PUSHED_SLABS + 1).collect()]
        if len(names) <= PUSHED_SLABS:
            rows = found.filter(any_of("slab", names))
        else:
            rows = found.join(slabs.select("slab").distinct(), "slab", "left_semi")
        scored = matching.score(rows, wanted, weights, match, True)
        scored = scored.select("search_id", doc_id(*map(F.col, KEY)).alias("id"), "micro")
        return top_k(scored, ["search_id"], order, limit, "id")

    first = stored(top_k(bounds, ["search_id"], [F.desc("most"), F.asc("slab")], FIRST, "slab"), "first")
    early = stored(best(first), "early")
    least = early.filter(F.col("position") == limit).select("search_id", F.col("micro").alias("least"))
    left = bounds.join(F.broadcast(first.select("slab").distinct()), "slab", "left_anti")
    left = left.join(F.broadcast(least), "search_id", "left")
    late = left.filter(F.col("least").isNull() | (F.col("most") >= F.col("least")))
    both = early.drop("position").unionByName(best(late).drop("position"))
    return top_k(both, ["search_id"], order, limit, "id").drop("position")
