"""Whole numbers out of vectors, exact at any size.

Numpy's 64-bit integers serve as long as no squared distance can overflow them; beyond that the same code
runs on arrays of Python integers. Sums leave the tasks as digits to the base 2**32, so that Spark adds
them exactly whatever their size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 2**63 - 1
_BASE = 1 << 32

#: Partial sums of a task: which table and cell they belong to, and one digit of them.
CELLS = "space int, cell int, place int, digit long"


def finite(vector: Column) -> Column:
    """Vectors that are there and hold neither nulls nor NaN nor infinities."""
    return vector.isNotNull() & ~F.exists(vector.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles for a power of two ``scale``."""
    if not x.size or np.abs(x).max() < 2.0**62 / scale:
        return np.floor(scale * x).astype(np.int64)
    whole = [int(v) * scale if abs(v) >= 2**53 else math.floor(v * scale) for v in x.ravel().tolist()]
    return np.array([*whole, None], object)[:-1].reshape(x.shape)


def fits(width: int, *arrays: np.ndarray) -> bool:
    """Whether squared distances over ``width`` components of such values stay within 64 bits."""
    if any(a.dtype == object for a in arrays):
        return False
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return width * (2 * most) ** 2 <= LONGEST


def saturated(values: np.ndarray) -> np.ndarray:
    """As 64-bit numbers; what is larger than the largest of them counts as that."""
    return values if values.dtype == np.int64 else np.array([min(int(v), LONGEST) for v in values.tolist()], np.int64)


def long_sum(column: str) -> Column:
    """Sum of longs >= 0 that stops at the largest long instead of overflowing."""
    return F.least(F.sum(F.col(column).cast("decimal(20,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")


def cells(space: int, totals: np.ndarray) -> pa.RecordBatch:
    """Rows of ``CELLS`` for all sums that are not zero."""
    rows = []
    for cell, total in enumerate(totals.ravel().tolist()):
        rest, sign, place = abs(int(total)), 1 if total > 0 else -1, 0
        while rest:
            rows.append((space, cell, place, sign * (rest % _BASE)))
            rest, place = rest // _BASE, place + 1
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["space", "cell", "place", "digit"])


def gathered(partial: DataFrame) -> dict[tuple[int, int], int]:
    """(space, cell) -> exact sum; as many entries as the tables have cells, whatever the rows."""
    sums: dict[tuple[int, int], int] = {}
    for r in partial.groupBy("space", "cell", "place").agg(F.sum("digit").alias("digit")).collect():
        key = r["space"], r["cell"]
        sums[key] = sums.get(key, 0) + r["digit"] * _BASE ** r["place"]
    return sums


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(rows, -1)
