"""Turning configured chat references into chats with titles, kinds and owners."""

from pyspark.sql import DataFrame, functions as F

from ..functions import names
from ..session import stored

NAME_KEY = "@"


def explode_chats(sessions: DataFrame) -> DataFrame:
    """One row per account and configured chat reference."""
    return sessions.select(
        F.col("name").alias("session_name"),
        F.posexplode("included_chats").alias("ref_pos", "chat_ref"),
    )


def unique_entities(entities: DataFrame) -> DataFrame:
    """Entities listed once each: the smallest of differing rows stays.

    They are written, so that joins with messages see a plain table, whose partner Spark can
    split where one entity has a large share of the messages.
    """
    rest = [c for c in entities.columns if c != "entity_id"]
    kept = entities.groupBy("entity_id").agg(F.min(F.struct(*rest)).alias("kept"))
    return stored(kept.select("entity_id", "kept.*").select(*entities.columns), "entities")


def require_sessions(sessions: DataFrame) -> DataFrame:
    """The account table, refused when it is empty."""
    if sessions.isEmpty():
        raise ValueError("at least one account is needed")
    return sessions


def resolve_refs(session_chats: DataFrame, entities: DataFrame) -> DataFrame:
    """Left join of references with entities; ``chat_id`` is null where nothing matches.

    Ids and usernames become one textual key, so that both kinds of reference are served
    by a single equi-join.
    """
    ref = F.col("chat_ref")
    refs = session_chats.select(
        "session_name",
        "chat_ref",
        F.coalesce(
            names.numeric_chat_id(ref).cast("string"),
            F.concat(F.lit(NAME_KEY), names.username(ref)),
        ).alias("key"),
    )
    by_name = F.concat(F.lit(NAME_KEY), F.lower(names.present(F.col("username"))))
    keyed = entities.select(
        F.explode(
            F.array_compact(F.array(F.col("entity_id").cast("string"), by_name))
        ).alias("key"),
        F.col("entity_id").alias("chat_id"),
        names.chat_title(F.col("title"), F.col("first_name")).alias("chat_title"),
        (F.col("kind") == names.PRIVATE_KIND).alias("is_private"),
    )
    return refs.join(keyed, "key", "left").drop("key")


def resolved_chats(session_chats: DataFrame, entities: DataFrame) -> DataFrame:
    """The chats each account follows, once per account even if an entity is listed twice."""
    return (
        resolve_refs(session_chats, entities)
        .filter(F.col("chat_id").isNotNull())
        .groupBy("session_name", "chat_id")
        .agg(F.min("chat_title").alias("chat_title"), F.min("is_private").alias("is_private"))
    )


def unresolved_refs(session_chats: DataFrame, entities: DataFrame) -> DataFrame:
    return (
        resolve_refs(session_chats, entities)
        .filter(F.col("chat_id").isNull())
        .select("session_name", "chat_ref")
    )


def own_names(sessions: DataFrame, entities: DataFrame) -> DataFrame:
    """Id and display name of each account's owner; the name is null if the owner is unknown."""
    name = names.display_name(
        F.col("first_name"), F.lit(None).cast("string"), F.col("last_name")
    )
    owners = entities.groupBy(F.col("entity_id").alias("own_id")).agg(F.min(name).alias("own_name"))
    return sessions.select(
        F.col("name").alias("session_name"), F.col("telegram_id").alias("own_id")
    ).join(owners, "own_id", "left")


def chat_lookup(session_chats: DataFrame, entities: DataFrame, sessions: DataFrame) -> DataFrame:
    """Everything a message needs to know about its chat and account, by (session, chat).

    Built once from the small side, so that the message table meets one lookup instead of
    a chat filter, a title join and an owner join.
    """
    return resolved_chats(session_chats, entities).join(
        own_names(sessions, entities), "session_name"
    )


def followed_sessions(session_chats: DataFrame, entities: DataFrame) -> DataFrame:
    """Number of resolved chats per account; accounts without any are left out."""
    return (
        resolved_chats(session_chats, entities)
        .groupBy("session_name")
        .agg(F.count("*").alias("n_chats"))
    )


def sessions_without_data(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Accounts for which nothing was delivered."""
    seen = messages.select(F.col("session_name").alias("name")).distinct()
    return sessions.join(seen, "name", "left_anti").select(F.col("name").alias("session_name"))


def sessions_summary(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        F.col("name").alias("session_name"),
        "telegram_id",
        F.size("included_chats").cast("bigint").alias("n_chats"),
    )
