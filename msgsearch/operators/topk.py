"""Top-k per key that survives a key with a large share of the rows."""

from math import isqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

# Above this k Spark no longer cuts each task's rows before the shuffle.
PUSHED_K = 1000


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int, tie: str) -> DataFrame:
    """The first ``k`` rows of each key in ``order``, with their ``position``.

    Up to ``PUSHED_K`` Spark limits each task's rows per key before shuffling. Beyond that the same cut is
    made here, over hashes of the unique column ``tie``: first in as many shares of a key as there are
    shuffle partitions, then in the square root of that, so a task sorts its share of the rows, and then at
    most ``k`` rows for each of about that many shares, whatever the number of rows.
    """
    if k > PUSHED_K:
        shares = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(tie), F.lit(shares)))
        rows = _cut(rows, [*keys, "salt"], order, k)
        rows = rows.withColumn("salt", F.pmod("salt", F.lit(max(1, isqrt(shares)))))
        rows = _cut(rows, [*keys, "salt"], order, k).drop("salt", "position")
    return _cut(rows, keys, order, k)


def _cut(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    whole = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(whole)).filter(F.col("position") <= k)
