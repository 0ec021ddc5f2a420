"""A run over several sittings: it stops where questions are open, keeps its state, and goes on with the answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcemeld.contract import Contract
from sourcemeld.operators import review
from sourcemeld.operators.push import NATURAL_KEYS, push_gate
from sourcemeld.plans import deliver
from sourcemeld.plans.reconcile import Decisions, Run, run
from sourcemeld.session import Scratch
from sourcemeld.settings import IN_REVIEW, READY
from sourcemeld.sources.sinks import AuditTrail, RunTables, TargetStore


@dataclass
class Sitting:
    """What came of one sitting: the run so far, its state, and the answers that were refused, with the reason."""

    run: Run
    stage: str
    status: str
    refused: DataFrame | None


def _known(tables: RunTables, name: str, run_id: str) -> DataFrame | None:
    return tables.read(name, [run_id]).drop("run_id") if run_id in tables.runs() else None


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in review.DECISION_COLUMNS.items()))


def advance(
    spark: SparkSession, tables: RunTables, run_id: str, sources: list[DataFrame], contract: Contract, answers: DataFrame | None = None, **options
) -> Sitting:
    """Take the run as far as its questions allow.

    ``answers`` (``DECISION_COLUMNS``) are held against the questions that the last sitting has left; accepted ones are kept
    with the run, and everything is computed again with all of them. The tables of this sitting replace those of the one before.
    """
    scratch = Scratch(spark)
    decided, refused = _known(tables, "decisions", run_id), None
    decided = _empty(spark) if decided is None else decided.select(*review.DECISION_COLUMNS)
    queue = _known(tables, "queue", run_id)
    if answers is not None:
        if queue is None:
            raise ValueError(f"run {run_id} has asked nothing yet")
        checked = scratch.write(review.check_decisions(answers, queue, _known(tables, "review_values", run_id)), "checked")
        accepted, refused = review.split_decisions(checked)
        decided = decided.unionByName(accepted.select(*review.DECISION_COLUMNS))
    decided = scratch.write(decided, "decisions")
    done = run(spark, sources, contract, Decisions(accepted=decided), gates=True, **options)
    items = scratch.write(review.with_review_id(done.reviews), "items")
    members = review.review_members(items)
    waiting = scratch.write(review.open_reviews(review.review_queue(items), decided, members), "queue")
    status = READY if waiting.isEmpty() else IN_REVIEW
    state = spark.createDataFrame([(done.stage, status)], "stage string, status string")
    kept = {"decisions": decided, "queue": waiting, "review_members": members, "review_values": review.review_values(items), "audit": done.audit, "state": state}
    kept |= {f"records_{n}": e.status for n, e in done.by_entity.items()} | {f"canonical_{n}": e.merged for n, e in done.by_entity.items()}
    if done.conflict_values is not None:
        kept["conflict_values"] = done.conflict_values
    tables.save(run_id, kept)
    return Sitting(done, done.stage, status, refused)


def state(tables: RunTables, run_id: str) -> tuple[str, str]:
    """(stage, status) that the last sitting of a run has left."""
    row = tables.read("state", [run_id]).first()
    return row["stage"], row["status"]


def push_run(
    tables: RunTables, run_id: str, done: Run, store: TargetStore, key_fields=NATURAL_KEYS, reject: Column | None = None, audit: AuditTrail | None = None
) -> dict[str, deliver.Delivery]:
    """Deliver all entities of a run whose stored state has no open question; the gate looks at the stored reviews itself."""
    _, status = state(tables, run_id)
    waiting = tables.read("queue", [run_id])
    push_gate(waiting, status)
    return {n: deliver.push(e, store, run_id, waiting, status, key_fields, reject, audit) for n, e in done.by_entity.items()}
