"""Run statistics, result sets and the activity feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemeld.settings import IN_REVIEW, PUSH_FAILED, PUSHED, READY, ROLLED_BACK

FEED_LENGTH = 160
SHOWN = (READY, PUSHED, PUSH_FAILED, ROLLED_BACK)


def run_stats(records: DataFrame, reviews: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row of counts: files, records, open reviews and records by outcome."""
    sources = records.select("source_file") if files is None else files.select("source_file")
    counts = records.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("status") == READY).alias("ready_to_push"),
        F.count_if(F.col("status") == PUSHED).alias("pushed"),
        F.count_if(F.col("status") == PUSH_FAILED).alias("push_failed"),
    )
    n_files = sources.distinct().agg(F.count(F.lit(1)).alias("n"))
    n_open = reviews.agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        n_files.scalar().alias("files"), "records", n_open.scalar().alias("reviews"), "ready_to_push", "pushed", "push_failed"
    )


def reconciled_status(open_reviews: Column) -> Column:
    return F.when(open_reviews > 0, IN_REVIEW).otherwise(READY)


def delivered_status(failed: Column) -> Column:
    return F.when(failed == 0, "COMPLETED").otherwise("PARTIAL_FAILURE")


def rollback_status(failed: Column) -> Column:
    return F.when(failed == 0, ROLLED_BACK).otherwise("ROLLBACK_PARTIAL_FAILURE")


def preview(records: DataFrame) -> DataFrame:
    """Records that are or were on their way to the target; all of them if there are none."""
    shown = F.col("status").isin(*SHOWN)
    any_shown = records.agg(F.coalesce(F.bool_or(shown), F.lit(False)).alias("any"))
    return records.where(shown | ~any_shown.scalar())


def source_table(rows: DataFrame) -> DataFrame:
    return rows.orderBy("source_file", "source_row_number")


def target_counts(records: DataFrame) -> DataFrame:
    return records.where(F.col("status") == PUSHED).groupBy("entity").agg(F.count(F.lit(1)).alias("n_rows"))


def union_table(frames: list[DataFrame]) -> DataFrame:
    """Rows of several shapes under the union of their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def all_keys(rows: DataFrame, column: str) -> DataFrame:
    """Union of the keys of a map column over all rows."""
    return rows.select(F.explode(F.map_keys(column)).alias("key")).distinct()


def activity_feed(history: DataFrame, live: DataFrame, length: int = FEED_LENGTH) -> DataFrame:
    """Latest distinct events of history and live feed, newest first."""
    keys = ["created_at", "type", "message"]
    both = history.select(*keys).unionByName(live.select(*keys)).dropDuplicates(keys)
    return both.orderBy(F.desc("created_at"), "type", "message").limit(length)
