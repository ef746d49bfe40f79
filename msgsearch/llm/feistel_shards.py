"""Sharding: a Feistel permutation over global row numbers as a reproducible shuffle.

The rows are numbered from 0 in the order of their key. A keyed Feistel network over pairs (left, right)
with left below ``a`` and right below ``b``, a * b just over the number of rows, permutes the numbers;
a number that lands outside is permuted again until it lands inside (cycle walking). The permuted
number modulo the shard count is the shard, divided by it the slot. Nothing is stored per row, so any
process can compute where row ``i`` lies (``place``). Shard sizes differ by one row at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from msgsearch.llm.common import numbered

SEED = 20_240_229
#: Every turn changes one half by the other one.
TURNS = 6
#: A prime below 2^31, so that products of two residues fit a signed 64-bit integer.
PRIME = 2_147_483_629
#: Steps of cycle walking in a column. The domain exceeds the rows by less than its square root: up to
#: 4,096 rows this many steps always suffice; beyond, a step fails with a chance below 1/64. A row still
#: outside would stop the job instead of being misplaced.
WALK = 66


def domain(rows: int) -> tuple[int, int]:
    """Sides of a near-square domain that holds the rows with little to spare."""
    rows = max(rows, 1)
    a = math.isqrt(rows)
    return a, -(-rows // a)


def turn_keys(seed: int) -> list[tuple[int, int]]:
    """Multiplier and summand of each turn, drawn from the seed by a linear congruence."""
    drawn, state = [], seed % PRIME
    for _ in range(2 * TURNS):
        state = (state * 48_271 + 11) % PRIME
        drawn.append(state or 1)
    return list(zip(drawn[::2], drawn[1::2]))


def permute(number, rows: int, seed: int = SEED):
    """One pass of the network over a number below a * b, for columns and integers alike."""
    a, b = domain(rows)
    right = number % b
    gap = number - right
    left = F.call_function("div", gap, F.lit(b)) if isinstance(number, Column) else gap // b
    for turn, (by, plus) in enumerate(turn_keys(seed)):
        inner = ((right if turn % 2 == 0 else left) * by + plus) % PRIME
        keyed = (inner * inner + plus) % PRIME
        if turn % 2 == 0:
            left = (left + keyed) % a
        else:
            right = (right + keyed) % b
    return left * b + right


def walked(number: Column, rows: int, seed: int = SEED) -> Column:
    """A permuted number brought below ``rows``; only numbers outside are permuted again."""
    found = F.aggregate(
        F.array_repeat(F.lit(0), WALK),
        number,
        lambda x, _: F.when(x < rows, x).otherwise(permute(x, rows, seed)),
    )
    checked = F.when(found < rows, found).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("bigint"))
    return F.when(number < rows, number).otherwise(checked)


def place(number: int, rows: int, shards: int, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of one row number, computed anywhere without the data."""
    number = permute(number, rows, seed)
    while number >= rows:
        number = permute(number, rows, seed)
    return number % shards, number // shards


def assign(rows: DataFrame, order: list[str], shards: int = 8, seed: int = SEED) -> DataFrame:
    """All rows with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard).

    ``order`` names the columns that number the rows, a key first and enough others to tell rows with the
    same key apart; rows equal in all of them are interchangeable. Nulls come first. An empty table gives
    an empty one. Columns named shard or slot are replaced. Give narrow rows: they are sorted and written
    once; ``write_shards`` brings texts along.
    """
    kept = numbered(rows.drop("shard", "slot", "_row", "_part", "_at", "_before", "_n"), order, "shards")
    total = kept.count()
    moved = kept.withColumn("_row", permute(F.col("_row").cast("bigint"), total, seed))
    return (
        moved.withColumn("_row", walked(F.col("_row"), total, seed))
        .withColumn("shard", F.pmod("_row", F.lit(shards)).cast("int"))
        .withColumn("slot", F.call_function("div", F.col("_row"), F.lit(shards)))
        .drop("_row")
    )


def write_shards(rows: DataFrame, order: list[str], path: str, shards: int = 8, seed: int = SEED) -> None:
    """Write the rows by shard, each file sorted by slot, every column included.

    Slots are cut in ranges of 2^20, so that a shard of any size is written by many tasks.
    """
    placed = assign(rows, order, shards, seed)
    block = F.shiftright("slot", 20)
    (
        placed.withColumn("_block", block)
        .repartition("shard", "_block")
        .sortWithinPartitions("shard", "slot")
        .drop("_block")
        .write.partitionBy("shard")
        .parquet(path)
    )


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, ``size`` (UTF-8 bytes and one; a missing text has none) and ``text_crc32`` of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))


def sharded_documents(documents: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """Where each document goes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Nulls, repeated rows and empty texts are rows like any other; a null text counts as an empty one.
    """
    placed = assign(measured(documents), ["doc_id", "text_crc32", "size"], shards, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
