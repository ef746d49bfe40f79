"""Identity, naming and direction rules of a message. Empty strings and zero count as missing."""

from pyspark.sql import Column, functions as F

PRIVATE_KIND = "user"


def present(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def nonzero(value: Column) -> Column:
    return F.nullif(value, F.lit(0).cast("bigint"))


def doc_id(session: Column, chat_id: Column, message_id: Column) -> Column:
    return F.concat_ws(":", session, chat_id.cast("string"), message_id.cast("string"))


def sender_id(user_id: Column, channel_id: Column, chat_id: Column) -> Column:
    return F.coalesce(nonzero(user_id), nonzero(channel_id), nonzero(chat_id))


def display_name(first: Column, title: Column, last: Column) -> Column:
    base = F.coalesce(present(first), present(title))
    return F.when(base.isNotNull(), F.concat_ws(" ", base, present(last)))


def chat_title(title: Column, first: Column) -> Column:
    return F.coalesce(present(title), present(first))


def receiver_name(
    is_private: Column, sender: Column, own_id: Column, title: Column, own_name: Column
) -> Column:
    incoming = is_private & ~sender.eqNullSafe(own_id)
    return F.when(incoming, own_name).otherwise(title)


def unix_date(date: Column) -> Column:
    """Seconds since the epoch of a timestamp, 0 when missing."""
    return F.coalesce(F.unix_timestamp(date.cast("timestamp")), F.lit(0).cast("bigint"))


def numeric_chat_id(ref: Column) -> Column:
    """Bare id of a numeric chat reference; null for a username.

    A ``-100`` prefix marks a channel only in front of ten or more digits.
    """
    digits = (
        F.when(ref.rlike(r"^-100[0-9]{10,}$"), F.substring(ref, 5, 64))
        .when(ref.rlike(r"^-[0-9]+$"), F.substring(ref, 2, 64))
        .when(ref.rlike(r"^[0-9]+$"), ref)
    )
    return digits.try_cast("bigint")


def username(ref: Column) -> Column:
    """Username of a non-numeric chat reference, without ``@`` and case."""
    return F.when(~ref.rlike(r"^-?[0-9]+$"), F.lower(F.regexp_replace(ref, "^@", "")))
