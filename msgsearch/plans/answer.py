"""The whole way of a request table: route, parse, scope, search, context, render, split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.flags import TOTAL_MAX
from ..operators.context import context
from ..operators.response import lines, response_chunks, responses
from ..session import stored
from . import requests as rq
from .search import REQUEST_LIMIT, batch_search


# What the later steps need of a hit.
HIT = ["request_id", "rank", "n_results", "session_name", "chat_id", "message_id"]


def contextual_hits(
    corpus, prepared: DataFrame, hits: DataFrame, bounded: bool = False
) -> DataFrame:
    """Hits of requests with their context rows, one row per request, hit and message."""
    asked = prepared.select("request_id", "full_text", "before", "after")
    wanted = hits.select(*HIT).join(asked, "request_id")
    return context(corpus, wanted, bounded)


def answer(
    corpus,
    requests: DataFrame,
    sessions: DataFrame,
    defaults: rq.Defaults = rq.Defaults(),
    unknown_user: str = "all",
    limit: int = REQUEST_LIMIT,
    match: str = "any",
) -> DataFrame:
    """Response chunks ``request_id, chunk_no, chunk`` for every search request."""
    corpus = corpus.pinned()
    prepared = stored(rq.prepare(requests, sessions, defaults, unknown_user), "requests")
    bounded = rq.is_bounded(
        requests.select(F.col("raw_text").alias("query")), per_request=limit * (TOTAL_MAX + 1)
    )
    hits = stored(
        batch_search(corpus, prepared, limit, match, bounded).select(*HIT), "hits"
    )
    rows = contextual_hits(corpus, prepared, hits, bounded)
    return response_chunks(responses(prepared, lines(rows)))
