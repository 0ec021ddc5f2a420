"""Clusters around centroids, with distances from tables of squared differences.

Components are whole numbers. In every round each task tabulates, for each dimension, each value that occurs in it
and each centroid, the squared difference; a distance is then a sum of table entries, and no
product is computed per vector. A round sends one sum per centroid and dimension from each task, so what is
shuffled and what reaches the driver does not grow with the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcemeld.llm.integers import CELLS, cells, finite, fits, floors, gathered, matrix, saturated
from sourcemeld.session import Scratch

#: Values between the smallest and the largest of a dimension up to which the table covers all of them.
DENSE = 4096
_ROWS = 4096  # vectors whose distances are held at once


class ScalarTables:
    """The tables of one round."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.low = self.high = self.table = None

    def _squares(self, values: np.ndarray, dimension: np.ndarray) -> np.ndarray:
        """One row per (dimension, value), one column per centroid."""
        apart = values[:, None] - self.centroids.T[dimension]
        return apart * apart

    def _look_up(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(table, its row for each component)."""
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        if self.low is not None:
            low, high = np.minimum(low, self.low), np.maximum(high, self.high)
        dimensions = np.arange(vectors.shape[1])
        if (high - low < DENSE).all():
            spans = (high - low + 1).astype(np.int64)
            first = np.cumsum(spans) - spans
            if self.table is None or (low < self.low).any() or (high > self.high).any():
                self.low, self.high = low, high
                values = np.arange(int(spans.sum())) - np.repeat(first - low, spans)
                self.table = self._squares(values, np.repeat(dimensions, spans))
            return self.table, vectors - low + first
        # Values far apart: the table holds those that occur in these vectors.
        found = [np.unique(vectors[:, d], return_inverse=True) for d in dimensions]
        sizes = np.array([len(values) for values, _ in found])
        table = self._squares(np.concatenate([values for values, _ in found]), np.repeat(dimensions, sizes))
        return table, np.stack([places for _, places in found], axis=1) + (np.cumsum(sizes) - sizes)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) per vector; ties go to the smaller number."""
        if not fits(vectors.shape[1], vectors, self.centroids):
            vectors = vectors.astype(object)
            table, places = ScalarTables(self.centroids.astype(object))._look_up(vectors)
        else:
            table, places = self._look_up(vectors)
        places = places.astype(np.int64)
        total = table[places[:, 0]]
        for d in range(1, places.shape[1]):
            total += table[places[:, d]]
        best = total.argmin(axis=1)
        return best, total[np.arange(len(total)), best]


def _blocks(batch: pa.RecordBatch, vector: str, scale: int):
    for start in range(0, batch.num_rows, _ROWS):
        part = batch.slice(start, _ROWS)
        yield part, floors(matrix(part.column(vector), part.num_rows), scale)


def _round(centroids: np.ndarray, scale: int):
    """Vectors -> sums and counts of every cluster."""

    def run(batches):
        k, width = centroids.shape
        totals = np.zeros((k, width + 1), object)
        tables = ScalarTables(centroids)
        for batch in batches:
            for _, vectors in _blocks(batch, "v", scale):
                best, _ = tables.nearest(vectors)
                for c in np.unique(best):
                    mine = vectors[best == c]
                    totals[c, :width] += mine.sum(axis=0).astype(object)
                    totals[c, width] += len(mine)
        yield cells(0, totals)

    return run


def usable(vectors: DataFrame, *, width: int, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has ``width`` components, none of them null or not finite."""
    return vectors.where((F.size(vector) == width) & finite(F.col(vector)))


def fit(vectors: DataFrame, *, k: int, rounds: int, scale: int, id: str = "vec_id", vector: str = "embedding") -> list[list[int]]:
    """Centroids after ``rounds`` rounds over usable vectors of one length, read once per round.

    A component x counts as floor(scale * x). The first centroids are the ``k`` vectors whose ids have the smallest
    SHA-256 of ``1:<id>``; ids that are null come last, rows that share an id go by their components. With fewer vectors there
    are fewer centroids. A centroid without vectors stays as it is.
    """
    body = F.col(vector).cast("array<double>").alias("v")
    chance = F.sha2(F.concat(F.lit("1:"), F.col(id).cast("string")), 256).alias("chance")
    first = vectors.select(chance, body).orderBy(F.asc_nulls_last("chance"), "v").limit(k).collect()
    if not first:
        return []
    centroids = floors(np.array([r["v"] for r in first]), scale)
    for _ in range(rounds):
        sums = gathered(vectors.select(body).mapInArrow(_round(centroids, scale), CELLS))
        whole = centroids.astype(object)
        step = whole.shape[1] + 1
        for c in range(len(whole)):
            count = sums.get((0, c * step + step - 1), 0)
            if count:
                whole[c] = [sums.get((0, c * step + d), 0) // count for d in range(step - 1)]
        small = max(abs(x) for x in whole.ravel()) < 2**62
        centroids = whole.astype(np.int64) if small else whole
    return [[int(x) for x in c] for c in centroids]


def assign(
    vectors: DataFrame, centroids: list[list[int]], *, scale: int, vector: str = "embedding", cluster: str = "cluster", distance: str = "distance"
) -> DataFrame:
    """All columns of usable vectors plus the number of the nearest centroid and the squared distance to it.

    A distance beyond the largest long is given as that. Columns named like the two new ones are replaced.
    """
    keep = [c for c in vectors.columns if c not in (cluster, distance)]
    renamed = vectors.select(*[vectors[c].alias(f"k{i}") for i, c in enumerate(keep)], vectors[vector].cast("array<double>").alias("v"))
    numbers = np.array([[*map(int, c), None] for c in centroids], object)[:, :-1] if centroids else np.zeros((0, 0), np.int64)
    if centroids and max(abs(x) for x in numbers.ravel()) < 2**62:
        numbers = numbers.astype(np.int64)

    def run(batches):
        tables = ScalarTables(numbers)
        for batch in batches:
            for part, whole in _blocks(batch, "v", scale):
                best, far = tables.nearest(whole)
                columns = [part.column(f"k{i}") for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(best.astype(np.int32)), pa.array(saturated(far))], names=[*keep, cluster, distance]
                )

    schema = T.StructType([vectors.schema[c] for c in keep]).add(cluster, T.IntegerType()).add(distance, T.LongType())
    return renamed.mapInArrow(run, schema)


def clusters(
    vectors: DataFrame, scratch: Scratch, *, k: int, rounds: int, scale: int, width: int, id: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """(rows with ``cluster`` and ``distance``, final centroids) of all vectors of ``width`` components.

    Other vectors, null ones and those with a null, NaN or infinite component are left out. Rows with a null id, repeated rows and ties
    take part like any other. An empty table has no centroids and no rows.
    """
    good = scratch.write(usable(vectors, width=width, vector=vector), "vectors")
    centroids = fit(good, k=k, rounds=rounds, scale=scale, id=id, vector=vector)
    return scratch.write(assign(good, centroids, scale=scale, vector=vector), "clusters"), centroids
