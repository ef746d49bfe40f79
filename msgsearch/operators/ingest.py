"""Deciding what is new, and counting it."""

from pyspark.sql import DataFrame, functions as F

from ..schemas import DOCUMENT_COLUMNS

CHAT = ["session_name", "chat_id"]


def dedupe_by_id(documents: DataFrame) -> DataFrame:
    """One document per id: the earliest, and the smallest of equally early ones.

    Copies are combined before the shuffle, so many copies of one id do not meet in one
    task, and the choice does not depend on the order in which they arrive.
    """
    rest = [c for c in DOCUMENT_COLUMNS if c not in ("id", "date")]
    kept = documents.groupBy("id").agg(F.min(F.struct("date", *rest)).alias("kept"))
    return kept.select("id", "kept.*").select(*DOCUMENT_COLUMNS)


def new_by_id(
    documents: DataFrame, indexed: DataFrame, small: bool = False, on: list[str] = ["id"]
) -> DataFrame:
    """Documents whose id is not indexed yet.

    For a batch of checked, ``small`` size the index is first reduced to the ids that come
    again: a scan of the key columns against a broadcast set, without a shuffle of the index.
    """
    known = indexed.select(*on)
    if small:
        known = known.join(F.broadcast(documents.select(*on)), on, "left_semi")
    return documents.join(known, on, "left_anti")


def high_water_mark(documents: DataFrame) -> DataFrame:
    return documents.groupBy(*CHAT).agg(F.max("message_id").alias("max_message_id"))


def beyond_marks(documents: DataFrame, indexed: DataFrame) -> DataFrame:
    """A report: documents newer than the newest indexed one of their chat.

    It leaves out what lies in holes; indexing goes by :func:`new_by_id`.
    """
    marks = high_water_mark(indexed)
    beyond = F.col("max_message_id").isNull() | (F.col("message_id") > F.col("max_message_id"))
    return documents.join(marks, CHAT, "left").filter(beyond).select(*documents.columns)


def ingest_counts(documents: DataFrame) -> DataFrame:
    """Documents per chat, with a null chat for the total of an account."""
    per_chat = documents.groupBy(*CHAT).agg(F.count("*").alias("n"))
    return (
        per_chat.rollup(*CHAT)
        .agg(F.sum("n").alias("n_documents"))
        .filter(F.col("session_name").isNotNull())
    )


def chat_coverage(raw: DataFrame) -> DataFrame:
    """How far back a chat's rows reach, in percent of its newest message id."""
    top, low = F.max("message_id"), F.min("message_id")
    return raw.groupBy(*CHAT).agg(
        F.count("*").alias("n_rows"),
        F.when(top > 0, (top - low) / top * 100).alias("percent"),
    )


def document_count(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("n_documents"))


def documents_exist(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """The asked ids with a flag; the archive is only scanned for them."""
    found = (
        documents.select("id")
        .join(ids.select("id"), "id", "left_semi")
        .distinct()
        .withColumn("exists", F.lit(True))
    )
    return ids.join(found, "id", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def filter_documents(
    documents: DataFrame,
    session_name: str | None = None,
    chat_id: int | None = None,
    sender_id: int | None = None,
) -> DataFrame:
    """Conjunction of the equality filters that are given."""
    wanted = {"session_name": session_name, "chat_id": chat_id, "sender_id": sender_id}
    for name, value in wanted.items():
        if value is not None:
            documents = documents.filter(F.col(name) == value)
    return documents
