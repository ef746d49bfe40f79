"""Messages around each hit."""

from pyspark.sql import DataFrame, functions as F

from ..functions.flags import TOTAL_MAX, context_budget
from ..functions.names import doc_id
from ..session import stored
from .sequence import CHAT, GROUP_BITS, SLAB_BITS, sequence_in, slab_offsets, slabs_around

# Width of the position ranges on which hits and messages meet. A hit with its context
# touches at most two of them.
WIDTH = TOTAL_MAX + 1


def _band(position):
    return F.floor(position / WIDTH).cast("bigint")


def neighbours(
    hits: DataFrame,
    message_keys: DataFrame,
    directory: DataFrame,
    bounded: bool = False,
    slab_bits: int = SLAB_BITS,
    group_bits: int = GROUP_BITS,
) -> DataFrame:
    """Ids of the nearest messages before and after each hit, in its chat and account.

    ``hits`` carry the chat columns, ``message_id, before, after`` and any further columns,
    which are kept; ``message_id`` comes back as ``hit_message_id``. ``directory`` counts the
    messages per slab: it tells which slabs can hold context, and only those are read and
    ranked, however long the chat. Hits meet messages on narrow position bands, so that many
    hits in one chat are not compared with all its messages. Messages with a negative id
    count only where they follow the hit.
    """
    small = F.broadcast if bounded else (lambda df: df)
    chats = hits.select(*CHAT).distinct()
    offsets = stored(
        slab_offsets(directory.join(small(chats), CHAT, "left_semi"), group_bits), "offsets"
    )
    slabs = slabs_around(hits, offsets, TOTAL_MAX, slab_bits, bounded)
    positions = stored(
        sequence_in(message_keys, slabs, slab_bits, bounded).select(*CHAT, "message_id", "seq"),
        "positions",
    )
    before, after = context_budget(F.col("before"), F.col("after"))
    asked = hits.withColumns({"before": before, "after": after})
    located = positions.join(small(asked), [*CHAT, "message_id"])
    spans = located.select(
        *CHAT,
        *[c for c in hits.columns if c not in (*CHAT, "message_id", "before", "after")],
        F.col("message_id").alias("hit_message_id"),
        (F.col("seq") - F.col("before")).alias("from_seq"),
        (F.col("seq") + F.col("after")).alias("to_seq"),
    ).withColumn("band", F.explode(F.sequence(_band(F.col("from_seq")), _band(F.col("to_seq")))))
    members = positions.withColumn("band", _band(F.col("seq")))
    near = members.join(small(spans), [*CHAT, "band"]).filter(
        F.col("seq").between(F.col("from_seq"), F.col("to_seq"))
        & ((F.col("message_id") >= 0) | (F.col("message_id") >= F.col("hit_message_id")))
    )
    return near.select(
        doc_id(F.col("session_name"), F.col("chat_id"), F.col("message_id")).alias("id"),
        *[c for c in spans.columns if c not in (*CHAT, "band", "from_seq", "to_seq")],
    )


def context(corpus, hits: DataFrame, bounded: bool = False) -> DataFrame:
    """The documents around each hit, the hit included."""
    near = neighbours(hits, corpus.message_keys(), corpus.slab_directory(), bounded)
    return corpus.fetch(near, bounded)
