"""Holes in the message ids of chats, without gathering a chat in one task."""

from pyspark.sql import DataFrame, Window, functions as F

from .sequence import CHAT, GROUP_BITS, SLAB_BITS, with_slab_number

GAP = [*CHAT, "after_id", "before_id", "n_missing"]


def _between(rows: DataFrame, after: str, before: str) -> DataFrame:
    missing = F.col(before) - F.col(after) - 1
    gaps = rows.select(*CHAT, F.col(after).alias("after_id"), F.col(before).alias("before_id"), missing.alias("n_missing"))
    return gaps.filter("n_missing > 0")


def chat_gaps(keys: DataFrame, slab_bits: int = SLAB_BITS, group_bits: int = GROUP_BITS) -> DataFrame:
    """Each run of missing ids between two neighbouring messages of a chat.

    Neighbours inside a slab of consecutive ids meet in a window over that slab. The ends of the slabs are
    stitched in windows over groups of slabs, and those of the groups over the chat, so that no window
    holds more than the ids of a slab, the slabs of a group, or the groups of a chat. What is missing before
    the first and behind the last message of a chat is not known and no gap. Repeated ids are one.
    """
    inside = Window.partitionBy(*[c for c in ("slab",) if c in keys.columns], *CHAT, "slab_no").orderBy("message_id")
    located = with_slab_number(keys, slab_bits).withColumn("before", F.lag("message_id").over(inside))
    ends = located.groupBy(*CHAT, "slab_no").agg(F.min("message_id").alias("low"), F.max("message_id").alias("high"))
    ends = ends.withColumn("grp", F.shiftright("slab_no", group_bits))
    order = Window.partitionBy(*CHAT, "grp").orderBy("slab_no")
    slabs = ends.withColumn("before", F.lag("high").over(order))
    groups = ends.groupBy(*CHAT, "grp").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    groups = groups.withColumn("before", F.lag("high").over(Window.partitionBy(*CHAT).orderBy("grp")))
    parts = [_between(located, "before", "message_id"), _between(slabs, "before", "low"), _between(groups, "before", "low")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
