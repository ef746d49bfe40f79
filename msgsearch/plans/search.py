"""Answering one search, or a whole table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.names import doc_id
from ..operators import matching
from ..operators.postings import KEY
from ..operators.topk import PUSHED_K, top_k
from ..schemas import DOCUMENT_COLUMNS
from ..session import stored
from ..sources.corpus import PUSHED_KEYS
from . import requests as rq
from .grid import grid_search
from .skipping import skipping_search

# Result limits.
SEARCH_LIMIT = 20
REQUEST_LIMIT = 10


def _best_first():
    return [F.desc("micro"), F.asc("id")]


def ranked_searches(
    corpus,
    searches: DataFrame,
    limit: int,
    match: str = "any",
    bounded: bool = False,
) -> DataFrame:
    """The best ``limit`` documents of each search in its scope, with ``search_id`` and ``score``.

    ``bounded`` says that the table is of checked size: its clauses are then sent to the postings. A
    larger one meets them on a grid. Either way the postings are read once, or, where an index can tell
    that slabs hold none of the best, in part.
    """
    if match not in ("any", "all"):
        raise ValueError("match is 'any' or 'all'")
    corpus = corpus.pinned()
    order = _best_first()
    few = bounded and searches.limit(PUSHED_KEYS // limit + 1).count() * limit <= PUSHED_KEYS
    if bounded:
        best = _best(corpus, matching.clauses(searches, corpus.lexicon), limit, order, match)
    else:
        best = grid_search(corpus, searches, limit, order, match)
    hits = corpus.fetch(best, bounded, few)
    return hits.select(
        "search_id", *DOCUMENT_COLUMNS, (F.col("micro") / matching.MICRO).alias("score")
    )


def _best(corpus, wanted: DataFrame, limit: int, order: list, match: str) -> DataFrame:
    asked = corpus.asked(wanted)
    if asked and limit <= PUSHED_K:
        best = skipping_search(corpus, wanted, asked, limit, order, match)
        if best is not None:
            return best
    found, weights = corpus.lookup(wanted, True, asked)
    scored = matching.score(found, wanted, weights, match, True)
    scored = scored.select("search_id", doc_id(*map(F.col, KEY)).alias("id"), "micro")
    return top_k(scored, ["search_id"], order, limit, "id").drop("position")


def with_result_rank(hits: DataFrame, key: str = "request_id") -> DataFrame:
    """Display position of each hit, newest first, and the number of hits.

    The windows hold one request's hits, so at most its limit.
    """
    order = [F.desc("date"), F.desc("score"), F.asc("id")]
    per_request = Window.partitionBy(key)
    return hits.withColumn(
        "rank", F.row_number().over(per_request.orderBy(*order)).cast("bigint")
    ).withColumn("n_results", F.count("*").over(per_request))


def batch_search(
    corpus,
    prepared: DataFrame,
    limit: int = REQUEST_LIMIT,
    match: str = "any",
    bounded: bool | None = None,
) -> DataFrame:
    """Ranked results of a table of prepared requests (see :func:`requests.prepare`)."""
    keyed = stored(rq.search_key(prepared), "searches")
    if bounded is None:
        bounded = rq.is_bounded(keyed, per_request=limit)
    searches = rq.distinct_searches(keyed)
    hits = ranked_searches(corpus, searches, limit, match, bounded)
    asked = keyed.filter("allowed") if "allowed" in keyed.columns else keyed
    asked = asked.select("request_id", "search_id")
    return with_result_rank(asked.join(hits, "search_id").drop("search_id"))


def search(
    corpus,
    query: str,
    limit: int = SEARCH_LIMIT,
    filters: dict | None = None,
    match: str = "any",
) -> DataFrame:
    """Results of one query, newest first. Known filter keys: session_name, chat_id, sender_id."""
    types = {"session_name": "string", "chat_id": "bigint", "sender_id": "bigint"}
    scope = {k: v for k, v in (filters or {}).items() if k in types}
    columns = [f"scope_{k} {types[k]}" for k in scope]
    one = corpus.spark.createDataFrame(
        [("1", query, *scope.values())], ", ".join(["search_id string, query string", *columns])
    )
    bounded = len(query) <= rq.MAX_CHARS and limit <= rq.MAX_DERIVED
    hits = ranked_searches(corpus, one, limit, match, bounded)
    ranked = with_result_rank(hits, "search_id")
    return ranked.select(*DOCUMENT_COLUMNS, "score", "rank").orderBy("rank")


def result_counts(prepared: DataFrame, hits: DataFrame) -> DataFrame:
    """Number of results per request, 0 included."""
    counts = hits.groupBy("request_id").agg(F.count("*").alias("n"))
    return prepared.join(counts, "request_id", "left").select(
        "request_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_results")
    )
