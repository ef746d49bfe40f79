"""From raw messages to enriched documents."""

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import names
from ..schemas import DOCUMENT_COLUMNS, RAW_MESSAGE
from .resolve import chat_lookup

MESSAGE_KIND = "message"


def text_messages(raw: DataFrame) -> DataFrame:
    """Real messages that carry text; service rows and null or empty texts go."""
    return raw.filter((F.col("kind") == MESSAGE_KIND) & (F.length("text") > 0))


def with_sender_id(raw: DataFrame) -> DataFrame:
    return raw.withColumn(
        "sender_id",
        names.sender_id(F.col("from_user_id"), F.col("from_channel_id"), F.col("from_chat_id")),
    )


def with_sender_name(messages: DataFrame, entities: DataFrame) -> DataFrame:
    """Left join of the sender's display name.

    The people table grows with the archive, so the join carries no broadcast hint: Spark
    broadcasts it while it is below the session's threshold, and beyond that adaptive
    execution splits the partition of a sender, or of the missing sender, that is too big.
    An entity must be listed once (:func:`resolve.unique_entities`).
    """
    name = names.display_name(F.col("first_name"), F.col("title"), F.col("last_name"))
    people = entities.select(F.col("entity_id").alias("sender_id"), name.alias("sender_name"))
    return messages.join(people, "sender_id", "left")


def _seconds(raw: DataFrame):
    kind = raw.schema["date"].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return names.unix_date(F.col("date"))
    return F.coalesce(F.col("date"), F.lit(0).cast("bigint"))


def enrich(
    raw: DataFrame, entities: DataFrame, sessions: DataFrame, session_chats: DataFrame
) -> DataFrame:
    """Documents of the configured chats, from a batch or a streaming frame of raw messages."""
    lookup = chat_lookup(session_chats, entities, sessions)
    messages = with_sender_id(text_messages(valid_rows(raw))).withColumn("date", _seconds(raw))
    in_chats = messages.join(lookup, ["session_name", "chat_id"])
    named = with_sender_name(in_chats, entities)
    receiver = names.receiver_name(
        F.col("is_private"),
        F.col("sender_id"),
        F.col("own_id"),
        F.col("chat_title"),
        F.col("own_name"),
    )
    return named.select(
        names.doc_id(F.col("session_name"), F.col("chat_id"), F.col("message_id")).alias("id"),
        "chat_id",
        "message_id",
        "session_name",
        "text",
        "sender_id",
        "sender_name",
        names.present(receiver).alias("receiver_name"),
        "date",
        "chat_title",
    ).select(*DOCUMENT_COLUMNS)


def _has_key():
    return (
        F.col("session_name").isNotNull()
        & F.col("chat_id").isNotNull()
        & F.col("message_id").isNotNull()
    )


def valid_rows(raw: DataFrame) -> DataFrame:
    return raw.filter(_has_key())


def rejected_rows(raw: DataFrame) -> DataFrame:
    """Rows that cannot be identified, kept for inspection instead of stopping the job."""
    columns = [c for c in RAW_MESSAGE.fieldNames() if c in raw.columns]
    missing = F.concat_ws(
        ",",
        *[
            F.when(F.col(c).isNull(), F.lit(c))
            for c in ("session_name", "chat_id", "message_id")
        ],
    )
    return raw.filter(~_has_key()).select(
        F.concat(F.lit("missing "), missing).alias("reason"),
        F.to_json(F.struct(*columns)).alias("payload"),
    )
