"""The match rule and the ranking, as joins and aggregations.

A query is split at blanks into parts. Within a part all tokens are needed, in one and the
same field; parts and fields are alternatives. Each satisfied (part, field) clause adds the
BM25 weights of its terms to the document's score.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions import text
from .lexicon import Lexicon
from .postings import KEY, SENDER, TEXT, TITLE

# BM25 parameters.
K1 = 1.2
B = 0.75
# Weights are added up as whole millionths, so that a score does not depend on the order
# in which the shuffle delivers its summands.
MICRO = 1_000_000

# Optional columns of a search; where set, documents must equal them.
SCOPE = ["scope_session_name", "scope_chat_id", "scope_sender_id"]


def query_parts(searches: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """One row per part with any token: ``part_no``, the part itself and its distinct tokens.

    With a lexicon, ideographs give its words in place of pairs; documents must be analysed with the same one.
    """
    parts = searches.select(
        "*", F.posexplode(text.split_blanks(F.col("query"))).alias("part_no", "part")
    )
    if lexicon:
        found = lexicon.with_query_terms(parts, "part").withColumnRenamed("part_terms", "tokens")
    else:
        found = parts.withColumn("tokens", text.query_tokens(F.col("part")))
    return found.filter(F.size("tokens") > 0)


def clauses(searches: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """One row per search, part, field and required term.

    Text and title must contain all tokens; the sender must be the part itself.
    """
    parts = query_parts(searches, lexicon)
    scope = [c for c in SCOPE if c in searches.columns]
    per_field = F.array(
        F.struct(F.lit(TEXT).alias("field"), F.col("tokens").alias("terms")),
        F.struct(F.lit(TITLE).alias("field"), F.col("tokens").alias("terms")),
        F.struct(F.lit(SENDER).alias("field"), F.array("part").alias("terms")),
    )
    expanded = parts.select("search_id", *scope, "part_no", F.inline(per_field))
    return expanded.select(
        "search_id",
        *scope,
        "part_no",
        "field",
        F.size("terms").alias("n_terms"),
        F.explode("terms").alias("term"),
    )


def vocabulary(wanted: DataFrame) -> DataFrame:
    return wanted.select("field", "term").distinct()


def term_weights(stats: DataFrame, lengths: DataFrame, *keep: str) -> DataFrame:
    """Inverse document frequency and average field length per term.

    ``lengths`` has one row per searchable field, so it is always broadcast.
    """
    n, df = F.col("n_docs"), F.col("df")
    return stats.join(F.broadcast(lengths), "field").select(
        "field",
        "term",
        *keep,
        F.log1p((n - df + 0.5) / (df + 0.5)).alias("idf"),
        (F.col("total_len") / n).alias("avg_len"),
    )


def saturation(tf, dl, avg_len):
    """What a term's frequency in a document counts, in comparison with one of average length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_len))


def weight():
    """What a posting adds to the score of its document, in whole millionths."""
    tf, dl = F.col("tf"), F.col("dl")
    norm = tf + K1 * (1 - B + B * dl / F.col("avg_len"))
    return F.round(F.col("idf") * tf * (K1 + 1) / norm * MICRO).cast("bigint")


def with_needed(wanted: DataFrame) -> DataFrame:
    """Add ``needed``, the number of parts of the search that have any token."""
    return wanted.join(wanted.groupBy("search_id").agg(F.count_distinct("part_no").alias("needed")), "search_id")


def in_scope(rows: DataFrame) -> DataFrame:
    """Rows whose document is in the scope of the search it is matched with."""
    for column in SCOPE:
        if column in rows.columns and column.removeprefix("scope_") in rows.columns:
            limit = F.col(column)
            rows = rows.filter(limit.isNull() | (F.col(column.removeprefix("scope_")) == limit))
    return rows


def score(
    found: DataFrame, wanted: DataFrame, weights: DataFrame, match: str = "any", bounded: bool = False
) -> DataFrame:
    """Scores of all documents that match any clause, or any clause of every part, of a search.

    ``found`` are postings of the wanted terms, partitioned so that a document's rows lie
    together: the two aggregations then need no shuffle, however often a term occurs.
    ``bounded`` says that the caller has checked the size of ``wanted``.
    Scope columns of ``wanted``, where given, must equal those of the document.
    """
    wanted = with_needed(wanted) if match == "all" else wanted
    weighted = wanted.join(weights, ["field", "term"])
    rows = found.join(F.broadcast(weighted) if bounded else weighted, ["field", "term"])
    return scores(rows, match)


def scores(rows: DataFrame, match: str = "any") -> DataFrame:
    """The same from postings that are joined with their clauses already."""
    at = [c for c in ("cell", "slab") if c in rows.columns] + KEY
    needed = [F.first("needed").alias("needed")] * (match == "all")
    satisfied = (
        in_scope(rows)
        .groupBy("search_id", "part_no", "field", *at)
        .agg(
            F.sum(weight()).alias("micro"),
            F.count("*").alias("n_found"),
            F.first("n_terms").alias("n_terms"),
            *needed,
        )
        .filter(F.col("n_found") == F.col("n_terms"))
    )
    if match == "any":
        return satisfied.groupBy("search_id", *at).agg(F.sum("micro").alias("micro"))
    per_part = satisfied.groupBy("search_id", *at, "part_no").agg(F.sum("micro").alias("micro"), *needed)
    return (
        per_part.groupBy("search_id", *at)
        .agg(F.sum("micro").alias("micro"), F.count("*").alias("n_parts"), *needed)
        .filter(F.col("n_parts") == F.col("needed"))
        .drop("n_parts", "needed")
    )


def slab_bounds(tops: DataFrame, wanted: DataFrame, weights: DataFrame) -> DataFrame:
    """The most that any document of a slab can score: ``search_id, slab, most``.

    ``tops`` come from :meth:`MessageIndex.term_slabs`, ``wanted`` and ``weights`` have a checked size. A
    top counts for the average length of its own part; for a larger one it grows by the ratio at most.
    """
    weighted = wanted.join(weights.withColumnRenamed("avg_len", "avg_now"), ["field", "term"])
    rows = in_scope(tops.join(F.broadcast(weighted), ["field", "term"]))
    wider = F.greatest(F.lit(1.0), F.col("avg_now") / F.col("avg_len"))
    most = F.ceil(F.col("idf") * F.col("top") * wider * MICRO * (1 + 1e-9)) + 1
    terms = rows.groupBy("search_id", "slab", "part_no", "field", "term").agg(
        F.max(most).alias("most"), F.first("n_terms").alias("n_terms")
    )
    parts = terms.groupBy("search_id", "slab", "part_no", "field").agg(
        F.sum("most").alias("most"), F.count("*").alias("n_found"), F.first("n_terms").alias("n_terms")
    )
    whole = parts.filter(F.col("n_found") == F.col("n_terms"))
    return whole.groupBy("search_id", "slab").agg(F.sum("most").alias("most"))
