"""Standing searches: saved queries that arriving messages are matched with."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.names import doc_id
from ..operators import matching, postings


def saved_clauses(saved: DataFrame) -> DataFrame:
    """The clauses of saved queries; store them once, by term, and match every batch with them.

    ``saved`` has ``search_id, query`` and scopes like a table of searches. Queries without tokens match nothing.
    """
    return matching.with_needed(matching.clauses(saved))


def matches(documents: DataFrame, clauses: DataFrame, match: str = "any") -> DataFrame:
    """``search_id, id`` of every document and every saved query that it matches.

    The terms of the documents meet those of the queries by key, so the archive plays no part. A word of many
    messages and many queries gives a row for each pair that it is in, as the result does.
    """
    found = postings.postings(documents)
    rows = found.join(clauses, ["field", "term"])
    # Matching needs no weights.
    rows = rows.withColumns({"idf": F.lit(0.0), "avg_len": F.lit(1.0)})
    hits = matching.scores(rows, match)
    return hits.select("search_id", doc_id(*map(F.col, postings.KEY)).alias("id"))
