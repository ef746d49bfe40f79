"""Terms of documents, and the statistics that ranking needs."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..functions.names import present
from .lexicon import Lexicon

# The searchable fields. The sender is matched as a whole value.
TEXT, SENDER, TITLE = "text", "sender_name", "chat_title"
# The key of a document, from which its id follows, and what a search may filter on besides.
KEY = ["session_name", "chat_id", "message_id"]


def analysed(documents: DataFrame, lexicon: Lexicon | None) -> DataFrame:
    """Documents with the terms of their texts by a lexicon, where there is one."""
    return lexicon.with_index_terms(documents, TEXT, TITLE) if lexicon else documents


def _terms(documents: DataFrame, column: str) -> Column:
    """Terms of a text; those that a dictionary found, where the documents bring them."""
    given = f"{column}_terms"
    return F.col(given) if given in documents.columns else text.index_tokens(F.col(column))


def _field_tokens(documents: DataFrame) -> dict[str, Column]:
    sender = present(F.col("sender_name"))
    return {
        TEXT: _terms(documents, "text"),
        SENDER: F.when(sender.isNotNull(), F.array(sender)).otherwise(
            F.array().cast("array<string>")
        ),
        TITLE: _terms(documents, "chat_title"),
    }


def field_tokens(documents: DataFrame) -> DataFrame:
    """One row per document and field: ``field, dl, tokens`` with the document's key and sender."""
    keep = [*KEY, "sender_id"] + [c for c in ("slab",) if c in documents.columns]
    fields = F.array(
        *[
            F.struct(F.lit(name).alias("field"), tokens.alias("tokens"))
            for name, tokens in _field_tokens(documents).items()
        ]
    )
    per_field = documents.select(*keep, F.inline(fields).alias("field", "tokens"))
    return per_field.select(*keep, "field", F.size("tokens").cast("bigint").alias("dl"), "tokens")


def token_occurrences(documents: DataFrame) -> DataFrame:
    """One row per token occurrence: ``field, term, dl`` with the document's key and sender."""
    return exploded(field_tokens(documents))


def exploded(rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c != "tokens"], F.explode("tokens").alias("term"))


def with_only(rows: DataFrame, terms: list) -> DataFrame:
    """Rows of :func:`field_tokens` with no other tokens than some terms, rows with ``field, term``; ``dl`` stays."""
    named = {name: sorted({t.term for t in terms if t.field == name}) for name in (TEXT, SENDER, TITLE)}
    kept = F.array().cast("array<string>")
    for name, some in named.items():
        if some:
            kept = F.when(F.col("field") == name, F.filter("tokens", lambda token: token.isin(some))).otherwise(kept)
    return rows.withColumn("tokens", kept)


def total_lengths(rows: DataFrame) -> DataFrame:
    """:func:`field_stats` from the rows of :func:`field_tokens`."""
    return rows.groupBy("field").agg(F.count("*").alias("n_docs"), F.sum("dl").alias("total_len"))


def count_terms(occurrences: DataFrame) -> DataFrame:
    """Postings: one row per document, field and term with its frequency."""
    keys = [c for c in occurrences.columns if c != "tf"]
    return occurrences.groupBy(*keys).agg(F.count("*").alias("tf"))


def postings(documents: DataFrame) -> DataFrame:
    return count_terms(token_occurrences(documents))


def term_stats(rows: DataFrame) -> DataFrame:
    """Document frequency of each term.

    Looking at ``tf`` keeps the counting of terms below the same as in :func:`count_terms`,
    so that a plan with both shuffles the postings once.
    """
    return rows.groupBy("field", "term").agg(F.count_if(F.col("tf") > 0).alias("df"))


def field_stats(documents: DataFrame) -> DataFrame:
    """Number of documents and total length of each field, in one pass without exploding."""
    sizes = {name: F.size(tokens).cast("bigint") for name, tokens in _field_tokens(documents).items()}
    totals = documents.select(*[size.alias(name) for name, size in sizes.items()]).agg(
        F.count("*").alias("n_docs"),
        *[F.coalesce(F.sum(name), F.lit(0).cast("bigint")).alias(name) for name in sizes],
    )
    lengths = F.array(
        *[F.struct(F.lit(n).alias("field"), F.col(n).alias("total_len")) for n in sizes]
    )
    return totals.select("n_docs", F.inline(lengths)).select("field", "n_docs", "total_len")
