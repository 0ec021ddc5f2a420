"""Exact top-k by inner product with the threshold algorithm.

Every block of vectors keeps one list per dimension, sorted by the component. A query reads all lists
side by side from the end its own component favours, scores each vector it meets in full, and stops
once k scores are above the best sum that the components at the current depth allow. Queries and vectors
meet in blocks of bounded size; the k best of every block are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries that meet in one task at the most, on average.
BLOCK, QUERY_BLOCK = 4096, 1024
_FIRST_DEPTH = 32


class SortedLists:
    """The sorted lists of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.rising = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)  # column d: places by component d
        self.sorted = np.take_along_axis(self.vectors, self.rising.astype(np.int64), axis=0)

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, depth read) of the k largest products; equal scores by smaller id; ``own`` is left out.

        Components are whole numbers: doubles where sums of products stay exact in them (below 2**53), Python integers otherwise.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        met = self.ids == own
        places, scores = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)
        depth = 0
        while depth < n:
            to = min(n, max(_FIRST_DEPTH, 2 * depth))
            fresh = np.zeros(n, bool)
            fresh[self.rising[n - to : n - depth][:, up]] = True
            fresh[self.rising[depth:to][:, down]] = True
            if to == n:
                fresh[:] = True  # also what no list favours, when all components are 0
            fresh &= ~met
            met |= fresh
            new = np.flatnonzero(fresh)
            places, scores = np.concatenate((places, new)), np.concatenate((scores, self.vectors[new] @ query))
            top = np.lexsort((places, -scores))[:k] if scores.dtype != object else sorted(range(len(scores)), key=lambda i: (-scores[i], places[i]))[:k]
            places, scores = places[top], scores[top]
            depth = to
            limit = self.sorted[n - depth][up] @ query[up] + self.sorted[depth - 1][down] @ query[down]
            if len(scores) == k and scores[-1] > limit:
                break
        return self.ids[places], scores, depth


def _longs(scores: np.ndarray) -> np.ndarray:
    """As 64-bit numbers; what is beyond them counts as the largest or smallest one."""
    if scores.dtype != object:
        return scores.astype(np.int64)
    return np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in scores.tolist()], np.int64)


def _meet(k: int):
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("vec_id").to_numpy()
        vectors = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        small = not len(ids) or float(np.abs(vectors.astype(float)).max()) ** 2 * vectors.shape[1] < 2**53
        vectors = vectors.astype(float if small else object)
        lists = SortedLists(ids[~asks], vectors[~asks])
        found = [(q, *lists.best(v, q, k)[:2]) for q, v in zip(ids[asks], vectors[asks])]
        return pa.table(
            {
                "query_id": pa.array(np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]).astype(np.int64)),
                "vec_id": pa.array(np.concatenate([i for _, i, _ in found]) if found else np.zeros(0, np.int64), pa.int64()),
                "score": pa.array(_longs(np.concatenate([s for _, _, s in found])) if found else np.zeros(0, np.int64)),
            }
        )

    return run


def nearest(queries: DataFrame, vectors: DataFrame, *, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k vectors with the largest integer products.

    Both tables hold vec_id (long) and v (array of whole numbers). A vector meets the queries of
    its own length whose id is another; null ids, null and empty vectors and those with a null component take no part.
    Equal scores go by the smaller id; with fewer than k candidates all are returned. Scores are exact; one beyond a long
    is given as the largest or smallest long.
    """

    def clean(df: DataFrame) -> DataFrame:
        df = df.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<bigint>").alias("v"), F.size("v").alias("dim"))

    queries, vectors = clean(queries), clean(vectors)
    blocks, query_blocks = -(-vectors.count() // BLOCK), -(-queries.count() // QUERY_BLOCK)
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(max(n, 1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    asked = queries.select("vec_id", "v", "dim", F.lit(True).alias("query"), place(query_blocks).alias("asks"), every(blocks).alias("block"))
    held = vectors.select("vec_id", "v", "dim", F.lit(False).alias("query"), every(query_blocks).alias("asks"), place(blocks).alias("block"))
    local = asked.unionByName(held).groupBy("dim", "asks", "block").applyInArrow(_meet(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
