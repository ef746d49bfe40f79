"""Keeping the index current, and answering requests, with Structured Streaming.

Every sink replaces the output of its micro-batch, so a batch that is tried again after a
failure leaves no second copy. A micro-batch is named by the id of its query, which lives in
the checkpoint, and its number: other queries and renewed checkpoints never meet its name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.enrich import enrich, rejected_rows, valid_rows
from ..operators.resolve import unique_entities
from ..plans.alerts import matches
from ..plans.answer import answer
from ..sources.index_store import MessageIndex
from ..sources.readers import CORRUPT, corrupt_rows

CHAT = ["session_name", "chat_id"]


def _start(writer, checkpoint: str, follow: str | None) -> StreamingQuery:
    """``follow`` is a processing interval; without it the query drains what is there and ends."""
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"processingTime": follow} if follow else {"availableNow": True}
    return writer.trigger(**trigger).start()


def _feed(batch: DataFrame) -> str:
    """The id of the query that a micro-batch belongs to."""
    name = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not name:
        raise RuntimeError("not inside a streaming query")
    return name


def start_ingest(
    raw: DataFrame,
    index: MessageIndex,
    entities: DataFrame,
    sessions: DataFrame,
    session_chats: DataFrame,
    checkpoint: str,
    source: str = "live",
    rejects: str | None = None,
    follow: str | None = None,
    saved: DataFrame | None = None,
    alerts: str | None = None,
) -> StreamingQuery:
    """Enrich and index a stream of raw messages.

    Run without ``follow`` for the backfill and with it, on the same checkpoint, to go on
    live: nothing that arrives in between is lost. Only messages of resolved chats are
    indexed. Ids that come again, in a batch or later, are indexed once. Rows without a key
    and unparsable records go to ``rejects``, and only there. Any number of streams may fill
    one index; ``source`` only makes the names of their batches readable.

    With ``saved`` (see :func:`plans.alerts.saved_clauses`) each new message is reported to ``alerts``
    once for every saved query that it matches: reports are written before the batch is published and
    replaced when it is tried again, and messages that another feed has brought are not new.
    """

    entities = unique_entities(entities)

    def report(number: int) -> Callable[[DataFrame], None]:
        return lambda fresh: _write_batch(matches(fresh, saved), alerts, number)

    def ingest(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if rejects:
                _write_batch(_rejects(batch), rejects, number)
            rows = valid_rows(_parsed(batch)).drop(CORRUPT)
            documents = enrich(rows, entities, sessions, session_chats)
            index.append(documents, f"{source}-{_feed(batch)}-{number}", report(number) if alerts else None)
        finally:
            batch.unpersist()

    return _start(raw.writeStream.foreachBatch(ingest), checkpoint, follow)


def _parsed(batch: DataFrame) -> DataFrame:
    return batch.filter(F.col(CORRUPT).isNull()) if CORRUPT in batch.columns else batch


def _rejects(batch: DataFrame) -> DataFrame:
    parsed = rejected_rows(_parsed(batch))
    return parsed.unionByName(corrupt_rows(batch)) if CORRUPT in batch.columns else parsed


def _write_batch(rows: DataFrame, path: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/feed={_feed(rows)}/batch_id={number}")


def dedup(documents: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """Drop ids that are delivered again within ``horizon`` of arrival, with bounded state.

    The watermark runs on arrival, not on message dates: history comes in any order, and no
    message may be dropped for its age. The append itself compares ids with the whole index,
    so this only saves work.
    """
    arrived = documents.withColumn("arrival", F.current_timestamp())
    watched = arrived.withWatermark("arrival", horizon)
    return watched.dropDuplicatesWithinWatermark(["id"]).drop("arrival")


def start_table(
    rows: DataFrame, path: str, checkpoint: str, follow: str | None = None
) -> StreamingQuery:
    """Append a stream to a Parquet folder, each micro-batch as its own partition."""
    sink = rows.writeStream.foreachBatch(lambda batch, number: _write_batch(batch, path, number))
    return _start(sink, checkpoint, follow)


def start_counts(
    documents: DataFrame, path: str, checkpoint: str, follow: str | None = None
) -> StreamingQuery:
    """Running number of documents per account and chat; read with :func:`latest_counts`."""
    counts = documents.groupBy(*CHAT).agg(F.count("*").alias("n_documents"))
    sink = counts.writeStream.outputMode("update").foreachBatch(
        lambda batch, number: _write_batch(batch.withColumn("written", F.current_timestamp()), path, number)
    )
    return _start(sink, checkpoint, follow)


def latest_counts(updates: DataFrame) -> DataFrame:
    """The newest count of each chat; ``updates`` is the folder :func:`start_counts` writes.

    Newest by the time of writing, so that a query on a renewed checkpoint is believed over
    the one before it.
    """
    order = F.struct("written", "batch_id")
    return updates.groupBy(*CHAT).agg(F.max_by("n_documents", order).alias("n_documents"))


def start_answers(
    requests: DataFrame,
    corpus: Callable[[], object],
    sessions: DataFrame,
    responses: str,
    checkpoint: str,
    follow: str | None = None,
    **options,
) -> StreamingQuery:
    """Answer a stream of requests from the tables as they are when a request arrives.

    ``corpus`` is called for each micro-batch; ``options`` go to :func:`plans.answer.answer`.
    """

    def respond(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            _write_batch(answer(corpus(), batch, sessions, **options), responses, number)
        finally:
            batch.unpersist()

    return _start(requests.writeStream.foreachBatch(respond), checkpoint, follow)
