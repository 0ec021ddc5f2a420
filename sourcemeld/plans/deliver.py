"""Push a finished run to the target, retry what failed, take everything back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemeld.operators.push import (
    NATURAL_KEYS,
    natural_key,
    push_gate,
    push_outcomes,
    pushed_status,
    rollback_keys,
    run_idempotency_key,
)
from sourcemeld.operators.results import delivered_status
from sourcemeld.plans.reconcile import EntityRun
from sourcemeld.session import Scratch
from sourcemeld.settings import PUSH_FAILED, PUSHED, READY, ROLLED_BACK
from sourcemeld.sources.sinks import AuditTrail, Conflict, TargetStore


@dataclass
class Delivery:
    status: DataFrame
    outcomes: DataFrame
    run_status: str


def _deliver(done: EntityRun, status, pushable, store, run_id, key_fields, reject, audit, actor, failed=None) -> Delivery:
    spark = status.sparkSession
    scratch = Scratch(spark)
    entity = done.entity
    waiting = status.where(F.col("status").isin(*pushable)).select("record_id")
    payload = (
        done.merged.select(F.col("primary_id").alias("record_id"), *entity.columns)
        .join(waiting, "record_id", "left_semi")
        .withColumns(
            {
                "record_key": natural_key(entity.names, key_fields),
                "idem_key": run_idempotency_key(run_id, F.col("record_id")),
            }
        )
    )
    payload = scratch.write(payload, "payload")
    outcomes = push_batch(payload, store, entity, scratch, reject, failed)
    after = scratch.write(pushed_status(status, outcomes), "status")
    failed = after.agg(F.count_if(F.col("status") == PUSH_FAILED).alias("n"))
    run_status = failed.select(delivered_status(F.col("n"))).first()[0]
    if audit is not None:
        action = F.when(F.col("outcome") == "rejected", "TARGET_PUSH_FAILED").otherwise("TARGET_PUSHED")
        audit.append(
            outcomes.select(
                F.lit(run_id).alias("run_id"), F.current_timestamp().cast("timestamp_ntz").alias("created_at"), "record_id",
                F.lit(actor).alias("actor"), action.alias("action"), F.col("outcome").alias("reason"), F.col("target_key").alias("data"),
            )
        )
        audit.append(_event(spark, run_id, actor, "MIGRATION_PUSH_COMPLETE", run_status))
    return Delivery(after, outcomes, run_status)


def push_batch(
    payload: DataFrame, store: TargetStore, entity, scratch: Scratch, reject: Column | None = None, failed: Column | None = None
) -> DataFrame:
    """Outcomes of a batch, and its accepted records in the target.

    Outcomes are written before the target changes, so that they stay what they were. If another writer has
    touched the same keys in between, they are worked out anew. ``failed`` marks records that the target refused last time.
    """
    while True:
        seen = store.version(entity)
        outcomes = scratch.write(push_outcomes(payload, store.ledger(entity, payload), reject, failed), "outcomes")
        accepted = outcomes.where("outcome = 'accepted'")
        if accepted.isEmpty():
            return outcomes
        try:
            store.write(entity, accepted, base=seen)
            return outcomes
        except Conflict:
            scratch.drop(outcomes)


def _event(spark, run_id: str, actor: str, action: str, reason: str) -> DataFrame:
    return spark.range(1).select(
        F.lit(run_id).alias("run_id"), F.current_timestamp().cast("timestamp_ntz").alias("created_at"),
        F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.lit(reason).alias("reason"),
    )


def push(
    done: EntityRun,
    store: TargetStore,
    run_id: str,
    open_reviews: int | DataFrame,
    run_status: str = READY,
    key_fields=NATURAL_KEYS,
    reject: Column | None = None,
    audit: AuditTrail | None = None,
) -> Delivery:
    """Deliver the records that are ready; refused ones stay behind as PUSH_FAILED."""
    push_gate(open_reviews, run_status)
    return _deliver(done, done.status, (READY,), store, run_id, key_fields, reject, audit, "agent")


def retry(
    done: EntityRun, status: DataFrame, store: TargetStore, run_id: str, key_fields=NATURAL_KEYS,
    reject: Column | None = None, audit: AuditTrail | None = None,
) -> Delivery:
    """Failed records again under the same idempotency keys, also where an older record was written under them."""
    return _deliver(done, status, (PUSH_FAILED,), store, run_id, key_fields, reject, audit, "consultant", F.lit(True))


def rollback(done: EntityRun, status: DataFrame, store: TargetStore, run_id: str, audit: AuditTrail | None = None) -> DataFrame:
    """Delete the keys the run has written; returns the record table afterwards."""
    store.delete(done.entity, rollback_keys(status))
    if audit is not None:
        audit.append(_event(status.sparkSession, run_id, "consultant", "ROLLBACK_COMPLETE", ROLLED_BACK))
    back = (F.col("status") == PUSHED) & F.col("target_key").isNotNull()
    return status.withColumn("status", F.when(back, ROLLED_BACK).otherwise(F.col("status")))
