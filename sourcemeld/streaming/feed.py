"""Continuous delivery: each micro-batch goes through the same push as a batch run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sourcemeld.contract import Entity
from sourcemeld.operators.push import natural_key, run_idempotency_key
from sourcemeld.plans.deliver import push_batch
from sourcemeld.session import Scratch
from sourcemeld.sources.sinks import TargetStore


def push_stream(
    records: DataFrame,
    store: TargetStore,
    entity: Entity,
    run_id: str,
    key_fields: tuple[str, ...],
    reject: Callable[[], Column] | None = None,
) -> DataStreamWriter:
    """Writer over a stream of contract records with ``record_id``.

    A batch that is replayed after a failure finds its idempotency keys in the ledger and
    writes nothing twice.
    """

    def deliver(batch: DataFrame, _: int) -> None:
        keyed = batch.withColumns(
            {
                "record_key": natural_key(entity.names, key_fields),
                "idem_key": run_idempotency_key(run_id, F.col("record_id")),
            }
        )
        scratch = Scratch(batch.sparkSession)
        push_batch(scratch.write(keyed, "batch"), store, entity, scratch, reject() if reject else None)
        scratch.close()

    return records.writeStream.foreachBatch(deliver)
