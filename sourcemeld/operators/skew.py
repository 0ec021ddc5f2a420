"""Joins that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcemeld.settings import LIMITS


def lookup_join(
    big: DataFrame, lookup: DataFrame, key: str, rows: int | None = None, hot_rows: int | None = None, counted: str | None = None
) -> DataFrame:
    """Left join of ``big`` with a lookup that has one row per key.

    Keys with at least ``hot_rows`` rows in ``big`` are looked up by broadcast. ``hot_rows`` is raised
    with the size of ``big``, so that no more than ``broadcast_rows`` keys can be hot. All other
    keys go through an ordinary shuffle join. ``rows`` is the size of ``big`` if it is known;
    below ``hot_rows`` no key can be hot and the split is left out. ``counted`` is a column of a written
    lookup with the number of rows of ``big`` that have its key; keys are then not counted again, keys outside
    the lookup have few rows, and without hot keys ``big`` is read once.
    """
    rows = big.count() if rows is None else rows
    hot_rows = hot_rows or max(LIMITS.hot_rows, -(-rows // LIMITS.broadcast_rows))
    if rows < hot_rows:
        return big.join(lookup, key, "left")
    if counted:
        hot_lookup = lookup.where(F.col(counted) >= hot_rows)
        hot = hot_lookup.select(key)
        if hot.isEmpty():
            return big.join(lookup, key, "left")
    else:
        hot = big.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= hot_rows).select(key)
        hot_lookup = hot.join(lookup, key, "left")
    cold_part = big.join(F.broadcast(hot), key, "left_anti").join(lookup, key, "left")
    hot_part = big.join(F.broadcast(hot_lookup), key)
    return cold_part.unionByName(hot_part)


def sized_join(big: DataFrame, lookup: DataFrame, key, lookup_rows: int, how: str = "left") -> DataFrame:
    """Join a counted lookup: broadcast within the limit, shuffled beyond it (split by AQE if skewed)."""
    if lookup_rows <= LIMITS.broadcast_rows:
        lookup = F.broadcast(lookup)
    return big.join(lookup, key, how)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition for work that is large per row, such as text similarity.

    A fixed number of partitions keeps adaptive execution from merging them by their few bytes.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
