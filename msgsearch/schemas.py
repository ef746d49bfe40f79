"""Fixed schemas of the message archive."""

from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()

# One enriched message.
DOCUMENT = _struct(
    ("id", _S, False),
    ("chat_id", _L, False),
    ("message_id", _L, False),
    ("session_name", _S, False),
    ("text", _S, False),
    ("sender_id", _L, True),
    ("sender_name", _S, True),
    ("receiver_name", _S, True),
    ("date", _L, False),
    ("chat_title", _S, True),
)
DOCUMENT_COLUMNS = DOCUMENT.fieldNames()

# One message as an export or a live feed delivers it.
RAW_MESSAGE = _struct(
    ("session_name", _S, True),
    ("chat_id", _L, True),
    ("message_id", _L, True),
    ("kind", _S, True),
    ("text", _S, True),
    ("from_user_id", _L, True),
    ("from_channel_id", _L, True),
    ("from_chat_id", _L, True),
    ("date", _L, True),
)

# A user, group or channel.
ENTITY = _struct(
    ("entity_id", _L, False),
    ("kind", _S, False),
    ("username", _S, True),
    ("first_name", _S, True),
    ("last_name", _S, True),
    ("title", _S, True),
)

# An account whose history is searched. ``pos`` keeps the configured order.
SESSION = _struct(
    ("pos", _I, False),
    ("name", _S, False),
    ("telegram_id", _L, False),
    ("included_chats", T.ArrayType(_S), False),
)

# A search request as a user typed it.
REQUEST = _struct(("request_id", _L, False), ("user_id", _L, True), ("raw_text", _S, True))
