"""Exact top-k search by inner product, a block at a time.

Vectors are cut into blocks of neighbouring ids. A block keeps a forward index (its vectors) and, for each
component, its largest and smallest value. For a query, the sum of what each component can add at most
bounds every score of the block. Blocks are taken in order of falling bounds and scored whole until the
next bound is below the k-th best score so far.

Scores are exact: rows are dealt by the size of their components to floating point, 64-bit whole numbers or
whole numbers of any size, so a few huge components make only the scores that they take part in slower.

Queries and candidates meet in a grid of cells, so that each task holds one share of both: a share of
candidates goes to as many cells as there are shares of queries, and the other way round. Every cell
returns k rows per query at most; the best of those are the answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

SCALE = 256
BLOCK = 128
#: Rows of one share.
QUERIES_EACH = 4096
VECTORS_EACH = 16384
#: Scores below these are exact in floating point, and in 64-bit whole numbers.
EXACT = (float(1 << 53), float(1 << 62))
KINDS = (np.float64, np.int64, object)
#: The largest double, and the range of a score.
LARGEST = float(np.finfo(np.float64).max)
LOW, HIGH = -(1 << 63), (1 << 63) - 1
FOUND = "query_id bigint, vec_id bigint, score bigint"


def whole_components(vector: Column) -> Column:
    """floor(256 * x) of each component, x as double; at most the largest double."""

    def whole(x: Column) -> Column:
        scaled = F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.lit(SCALE) * x.cast("double")))
        # From 2^53 on doubles are whole, and floor would end at 2^63.
        return F.when(F.abs(scaled) < EXACT[0], F.floor(scaled).cast("double")).otherwise(scaled)

    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: it is there and has finite components only."""
    huge = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == huge))
    return vector.isNotNull() & ~bad


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _tiers(matrix: np.ndarray) -> np.ndarray:
    """For each row the place in ``KINDS`` that its scores with rows of the same place, or an earlier one, need."""
    return np.searchsorted(np.sqrt(np.array(EXACT) / matrix.shape[1]), np.abs(matrix).max(axis=1), side="right")


def _as(matrix: np.ndarray, kind: type) -> np.ndarray:
    return np.vectorize(int, otypes=[object])(matrix) if kind is object and matrix.size else matrix.astype(kind)


class Blocks:
    """One share of candidates, sorted by id, in blocks."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        edges = np.arange(0, len(ids), BLOCK)
        self.largest = np.maximum.reduceat(matrix, edges, axis=0)
        self.smallest = np.minimum.reduceat(matrix, edges, axis=0)
        self.scored = 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What a score can be at most, per query and block."""
        return _limited(np.maximum(queries, 0) @ self.largest.T + np.minimum(queries, 0) @ self.smallest.T)

    def best(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, ties to smaller ids, without the query's own id."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0, self.matrix.dtype)
        for block in np.argsort(-bounds, kind="stable").tolist():
            if len(ids) == k and bounds[block] < scores[-1]:
                break
            own = slice(block * BLOCK, (block + 1) * BLOCK)
            new = _limited(self.matrix[own] @ query)
            self.scored += len(new)
            keep = self.ids[own] != query_id
            if len(ids) == k:
                keep &= new >= scores[-1]
            if keep.any():
                ids, scores = np.append(ids, self.ids[own][keep]), np.append(scores, new[keep])
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
        return ids, scores


def _limited(scores: np.ndarray) -> np.ndarray:
    """Scores beyond the range of a long count as its ends."""
    return np.clip(scores, LOW, HIGH) if scores.dtype == object else scores


def _search(k: int):
    def cell(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or vectors.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        vectors = vectors.sort_values("vec_id", kind="stable")
        width = max(1, queries["vector"].map(len).max(), vectors["vector"].map(len).max())
        asked, matrix = _matrix(queries["vector"], width), _matrix(vectors["vector"], width)
        names, ids, sizes = queries["query_id"].to_numpy(), vectors["vec_id"].to_numpy(), _tiers(matrix)
        out = []
        for large, some in _by(_tiers(asked)):
            for larger, held in _by(sizes):
                kind = KINDS[max(large, larger)]
                blocks = Blocks(ids[held], _as(matrix[held], kind))
                out += _answers(blocks, names[some], _as(asked[some], kind), k)
        return pd.concat(out, ignore_index=True)

    return cell


def _by(tiers: np.ndarray) -> list[tuple[int, np.ndarray]]:
    return [(int(t), np.flatnonzero(tiers == t)) for t in np.unique(tiers)]


def _answers(blocks: Blocks, names: np.ndarray, asked: np.ndarray, k: int) -> list[pd.DataFrame]:
    out = []
    for begin in range(0, len(asked), 256):
        bounds = blocks.bounds(asked[begin : begin + 256])
        for i, query_id in enumerate(names[begin : begin + 256].tolist()):
            ids, scores = blocks.best(query_id, asked[begin + i], bounds[i], k)
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": scores.astype("int64")}))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score (long) of the k best vectors of each query.

    ``vectors`` has vec_id and vector, ``queries`` query_id and vector (arrays of whole numbers as double);
    other columns stay behind. Rows with a null id or vector take no part. A query never finds its own id,
    nor rows that repeat it; a repeated query is answered once, for the smallest of its vectors. Shorter vectors count as ending in zeros.
    Scores are exact at any size; those beyond the range of a long count as its ends, ties among them as any
    others. Empty tables give an empty result.
    """
    vectors = vectors.where("vec_id IS NOT NULL AND vector IS NOT NULL").select("vec_id", "vector")
    queries = queries.where("query_id IS NOT NULL AND vector IS NOT NULL").groupBy("query_id").agg(F.min("vector").alias("vector"))
    columns = max(1, -(-vectors.count() // VECTORS_EACH))
    rows = max(1, -(-queries.count() // QUERIES_EACH))
    share = F.pmod(F.xxhash64("query_id"), F.lit(rows)).cast("int")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("c"), share.alias("r"), "query_id", "vector")
    dealt = F.pmod(F.xxhash64(F.shiftright("vec_id", 7)), F.lit(columns)).cast("int")
    held = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r"), dealt.alias("c"), "vec_id", "vector")
    found = asked.groupBy("r", "c").cogroup(held.groupBy("r", "c")).applyInPandas(_search(k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def embedding_neighbours(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k best neighbours of each row whose vec_id is divisible by ``every``."""
    taking = embeddings.where(usable(F.col("embedding"))).select("vec_id", whole_components(F.col("embedding")).alias("vector"))
    queries = taking.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    return top_k(taking, queries, k)
