"""Connected components of a table of links, by large and small stars in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from msgsearch.session import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node, root being the smallest node of its component.

    ``links`` has columns a and b. Each turn connects the neighbours of a node to its smallest one; the
    turns written in between end when no link changes, after about as many as the logarithm of the longest
    chain. Nothing but the number of changes reaches the driver.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        turned = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        changed = turned.exceptAll(edges).limit(1).count() or edges.exceptAll(turned).limit(1).count()
        edges = turned
        if not changed:
            break
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
