"""Position of each message within its chat, without gathering a chat in one task.

A chat may hold a large share of the archive, so a window over a whole chat is out of the
question. Messages are ranked inside slabs of 2**16 consecutive ids, and a slab's offset is
the number of messages in the slabs before it. Those offsets are again summed inside groups
of 2**22 slabs, so no window sees more than a bounded number of rows.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

CHAT = ["session_name", "chat_id"]
SLAB_BITS = 16
GROUP_BITS = 22


def slab_number(message_id: Column, bits: int = SLAB_BITS) -> Column:
    return F.shiftright(message_id, bits)


def slab_key(session: Column, chat_id: Column, message_id: Column) -> Column:
    """Hash of a slab: the unit by which index tables are bucketed."""
    return F.xxhash64(session, chat_id, slab_number(message_id))


def _bucketing(keys: DataFrame) -> list[str]:
    return [c for c in ("slab",) if c in keys.columns]


def with_slab_number(keys: DataFrame, bits: int = SLAB_BITS) -> DataFrame:
    return keys.withColumn("slab_no", slab_number(F.col("message_id"), bits))


def slab_directory(keys: DataFrame, bits: int = SLAB_BITS) -> DataFrame:
    """Number of messages ``n`` per chat and slab."""
    by_slab = [*_bucketing(keys), *CHAT, "slab_no"]
    counts = with_slab_number(keys, bits).groupBy(*by_slab).agg(F.count("*").alias("n"))
    return counts.select(*CHAT, "slab_no", "n")


def slab_offsets(directory: DataFrame, group_bits: int = GROUP_BITS) -> DataFrame:
    """Add to each slab of a chat its ``place`` among the chat's slabs, counted from 0, and
    its ``offset``, the number of messages in the slabs before it."""

    def before(keys: list[str], order: str, what: str) -> Column:
        earlier = (
            Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        )
        return F.coalesce(F.sum(what).over(earlier), F.lit(0).cast("bigint"))

    slabs = directory.groupBy(*CHAT, "slab_no").agg(F.sum("n").alias("n"))
    grouped = slabs.withColumn("grp", F.shiftright("slab_no", group_bits)).withColumn(
        "one", F.lit(1).cast("bigint")
    )
    groups = grouped.groupBy(*CHAT, "grp").agg(F.sum("n").alias("n"), F.sum("one").alias("one"))
    groups = groups.select(
        *CHAT,
        "grp",
        before(CHAT, "grp", "n").alias("base_n"),
        before(CHAT, "grp", "one").alias("base_one"),
    )
    inner = [*CHAT, "grp"]
    inside = grouped.select(
        *inner,
        "slab_no",
        "n",
        before(inner, "slab_no", "n").alias("inner_n"),
        before(inner, "slab_no", "one").alias("inner_one"),
    )
    return inside.join(groups, inner).select(
        *CHAT,
        "slab_no",
        "n",
        (F.col("base_n") + F.col("inner_n")).alias("offset"),
        (F.col("base_one") + F.col("inner_one")).alias("place"),
    )


def sequence_in(
    keys: DataFrame, offsets: DataFrame, bits: int = SLAB_BITS, bounded: bool = False
) -> DataFrame:
    """Add ``seq`` = 1, 2, ... in message order per chat to the messages of the given slabs.

    If ``keys`` carries the bucketing column ``slab``, the ranking needs no shuffle.
    """
    on = [*CHAT, "slab_no"]
    chosen = offsets.select(*on, "offset")
    located = with_slab_number(keys, bits).join(F.broadcast(chosen) if bounded else chosen, on)
    local = F.row_number().over(
        Window.partitionBy(*_bucketing(keys), *on).orderBy("message_id")
    )
    return located.select(*keys.columns, (F.col("offset") + local).alias("seq"))


def message_sequence(
    keys: DataFrame, slab_bits: int = SLAB_BITS, group_bits: int = GROUP_BITS
) -> DataFrame:
    """Add ``seq`` to all rows; message keys must be unique."""
    offsets = slab_offsets(slab_directory(keys, slab_bits), group_bits)
    return sequence_in(keys, offsets, slab_bits)


def slabs_around(
    hits: DataFrame, offsets: DataFrame, reach: int, bits: int = SLAB_BITS, bounded: bool = False
) -> DataFrame:
    """The slabs that hold the hits or any of the ``reach`` messages before and after them.

    Each slab of a chat holds at least one message, so these are at most ``reach`` places
    away; the candidates are looked up by place and cut down by their offsets.
    """
    small = F.broadcast if bounded else (lambda df: df)
    home = with_slab_number(hits.select(*CHAT, "message_id"), bits)
    home = home.select(*CHAT, "slab_no").distinct()
    spans = offsets.join(small(home), [*CHAT, "slab_no"]).select(
        *CHAT,
        F.explode(F.sequence(F.col("place") - reach, F.col("place") + reach)).alias("place"),
        (F.col("offset") - reach).alias("from_seq"),
        (F.col("offset") + F.col("n") + reach).alias("to_seq"),
    )
    near = offsets.join(small(spans), [*CHAT, "place"]).filter(
        (F.col("offset") + F.col("n") > F.col("from_seq")) & (F.col("offset") < F.col("to_seq"))
    )
    return near.select(*CHAT, "slab_no", "offset").distinct()
