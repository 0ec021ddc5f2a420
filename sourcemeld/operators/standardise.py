"""From source columns to contract fields: rename, standardise, keep errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemeld.contract import Entity, column
from sourcemeld.functions.steps import Chain, Step, error_reason, run_chains
from sourcemeld.functions.text import blank_to_null, strip
from sourcemeld.operators.skew import lookup_join, sized_join
from sourcemeld.settings import IN_REVIEW, LIMITS, TRANSFORMED


@dataclass(frozen=True)
class Mapped:
    """One source column that feeds a field; the order of these is the column order."""

    source_column: str
    target_field: str
    steps: tuple[Step, ...]
    value_map: DataFrame | None = None
    value_map_rows: int = 0


STEP_ERROR = (
    "array<struct<source_field:string,target_field:string,error:string,reason_code:string,"
    "applied:array<string>,value:string>>"
)


def last_success(pairs: list[tuple[Column, Column]]) -> Column:
    """Of several columns for one field the last that transformed without error wins, null or not."""
    choice = F.lit(None).cast("string")
    for value, error in pairs:
        choice = F.when(error.isNull(), value).otherwise(choice)
    return choice


def standardise_source(df: DataFrame, entity: Entity, mapping: list[Mapped]) -> DataFrame:
    """One narrow pass over a source; every contract field is a canonical text column.

    Rows with a failed step get status CONSULTANT_REVIEW and carry their errors; the failed
    value is not kept. Value maps are joined: broadcast within the limit, shuffled beyond it.
    """
    chains = [Chain(f"c{i}", F.col(f"`{m.source_column}`"), m.steps) for i, m in enumerate(mapping)]
    out = run_chains(df, chains, skip_missing=True)
    for i, m in enumerate(mapping):
        if m.value_map is not None:
            out = _join_value_map(out, f"c{i}", m)
    errors = [
        F.when(
            F.col(f"c{i}__error").isNotNull(),
            F.struct(
                F.lit(m.source_column).alias("source_field"),
                F.lit(m.target_field).alias("target_field"),
                F.col(f"c{i}__error").alias("error"),
                error_reason(F.col(f"c{i}__error")).alias("reason_code"),
                F.col(f"c{i}__applied").alias("applied"),
                F.col(f"`{m.source_column}`").cast("string").alias("value"),
            ),
        )
        for i, m in enumerate(mapping)
    ]
    step_errors = F.array_compact(F.array(*errors)) if errors else F.lit(None)
    step_errors = F.coalesce(step_errors.cast(STEP_ERROR), F.array().cast(STEP_ERROR))
    fields = []
    for name in entity.names:
        feeding = [
            (F.col(f"c{i}__value"), F.col(f"c{i}__error")) for i, m in enumerate(mapping) if m.target_field == name
        ]
        fields.append(blank_to_null(last_success(feeding)).alias(column(name)))
    return out.select(
        "record_id", "source_file", "source_row_number", *fields, step_errors.alias("step_errors")
    ).withColumn("status", F.when(F.size("step_errors") > 0, IN_REVIEW).otherwise(TRANSFORMED))


def _join_value_map(df: DataFrame, name: str, mapped: Mapped) -> DataFrame:
    """The trimmed value as it is, then without case; anything else is ``unmapped_value``, a missing value stays missing."""
    lookup = mapped.value_map.where("target is not null").select(
        F.col("value").alias(f"{name}__key"), F.col("target").alias(f"{name}__to")
    )
    keyed = df.withColumn(f"{name}__key", blank_to_null(strip(F.col(f"{name}__value"))))
    folded = lookup.groupBy(F.lower(f"{name}__key").alias(f"{name}__low")).agg(F.min_by(f"{name}__to", f"{name}__key").alias(f"{name}__near"))
    keyed = keyed.withColumn(f"{name}__low", F.lower(f"{name}__key"))
    joined = _looked_up(_looked_up(keyed, lookup, f"{name}__key", mapped.value_map_rows), folded, f"{name}__low", mapped.value_map_rows)
    target = F.coalesce(f"{name}__to", f"{name}__near")
    fine = F.col(f"{name}__error").isNull() & F.col(f"{name}__key").isNotNull()
    return joined.withColumns(
        {
            f"{name}__value": F.when(F.col(f"{name}__error").isNotNull() | (fine & target.isNull()), F.col(f"{name}__value")).otherwise(target),
            f"{name}__applied": F.when(fine & target.isNotNull(), F.array_append(f"{name}__applied", F.lit("map_value"))).otherwise(F.col(f"{name}__applied")),
            f"{name}__error": F.when(fine & target.isNull(), F.lit("unmapped_value")).otherwise(F.col(f"{name}__error")),
        }
    ).drop(f"{name}__key", f"{name}__to", f"{name}__low", f"{name}__near")


def _looked_up(df: DataFrame, lookup: DataFrame, key: str, rows: int) -> DataFrame:
    """Left join with a value map; most rows may hold one value, so beyond the broadcast limit hot values are split off."""
    if rows <= LIMITS.broadcast_rows:
        return sized_join(df, lookup, key, rows)
    return lookup_join(df, lookup, key)


def step_error_rows(records: DataFrame) -> DataFrame:
    """One row per failed step."""
    return records.where(F.size("step_errors") > 0).select(
        "record_id", "source_file", F.inline("step_errors")
    )
