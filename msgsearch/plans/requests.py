"""From request texts to searches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import flags
from ..operators.matching import SCOPE

# A request table within these bounds yields clause and hit tables that are small enough to
# send to every task; a larger one meets the postings on a grid. A character gives three
# clause rows at most, one for each field.
MAX_ROWS = 5_000
MAX_CHARS = 100_000
MAX_DERIVED = 200_000


@dataclass(frozen=True)
class Defaults:
    """Configured display settings that a request may override."""

    full_text: bool = False
    preceding_context: int = 0
    subsequent_context: int = 0


def routed(requests: DataFrame) -> DataFrame:
    """Requests with their route; ``query`` is null unless the route is a search."""
    raw = F.col("raw_text")
    return requests.withColumn("route", flags.route(raw)).withColumn(
        "query", flags.routed_query(raw)
    )


def with_flags(requests: DataFrame, defaults: Defaults = Defaults()) -> DataFrame:
    """Replace ``query`` by its words and add ``full_text, before, after``."""
    parsed = flags.parse_flags(
        F.col("query"),
        F.lit(defaults.full_text),
        F.lit(max(0, defaults.preceding_context)),
        F.lit(max(0, defaults.subsequent_context)),
    )
    return requests.withColumns(parsed)


def with_scope(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Left join of the requester's account: the first configured one with that user id."""
    accounts = sessions.groupBy(F.col("telegram_id").alias("user_id")).agg(
        F.min_by("name", "pos").alias("scope_session_name")
    )
    return requests.join(accounts, "user_id", "left")


def prepare(
    requests: DataFrame,
    sessions: DataFrame,
    defaults: Defaults = Defaults(),
    unknown_user: str = "all",
) -> DataFrame:
    """Search requests with words, flags and scope.

    A requester without an account searches every account; with ``unknown_user="none"`` such
    a requester finds nothing.
    """
    if unknown_user not in ("none", "all"):
        raise ValueError("unknown_user must be 'none' or 'all'")
    searches = routed(requests).filter(F.col("route") == "search")
    scoped = with_scope(with_flags(searches, defaults), sessions)
    known = F.lit(unknown_user == "all") | F.col("scope_session_name").isNotNull()
    return scoped.withColumn("allowed", known).drop("route")


def search_key(prepared: DataFrame) -> DataFrame:
    """Add ``search_id``: equal for requests that ask the same question of the same data."""
    scope = [c for c in SCOPE if c in prepared.columns]
    return prepared.withColumn("search_id", F.md5(F.to_json(F.struct("query", *scope))))


def distinct_searches(keyed: DataFrame) -> DataFrame:
    """Each question once, so that a popular one is answered once."""
    if "allowed" in keyed.columns:
        keyed = keyed.filter("allowed")
    scope = [c for c in SCOPE if c in keyed.columns]
    return keyed.select("search_id", "query", *scope).distinct()


def is_bounded(requests: DataFrame, per_request: int = 1) -> bool:
    """Whether tables of up to ``per_request`` rows for each request may be broadcast.

    Reads at most ``MAX_ROWS`` + 1 requests.
    """
    size = (
        requests.select(F.length("query").alias("n"))
        .limit(MAX_ROWS + 1)
        .agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("chars"))
        .first()
    )
    rows, chars = size["rows"], size["chars"]
    return rows <= MAX_ROWS and chars <= MAX_CHARS and rows * per_request <= MAX_DERIVED
