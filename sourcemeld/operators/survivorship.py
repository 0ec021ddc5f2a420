"""One surviving record per group, conflicts and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemeld.contract import Entity, column
from sourcemeld.functions.text import conflict_key, filled, match_key
from sourcemeld.operators.identity import record_key
from sourcemeld.operators.skew import lookup_join
from sourcemeld.settings import READY, RECONCILED

CONFLICT = "array<struct<field:string,silent:boolean>>"


def source_rank(names, source: Column) -> Column:
    """Place of a source in a list; unlisted ones come last."""
    if not names:
        return F.lit(0)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), source)
    return F.when(place > 0, place.cast("int") - 1).otherwise(len(names))


def merge_groups(members: DataFrame, entity: Entity, source_order: list[str] | None = None) -> DataFrame:
    """Field-level survivorship in one aggregation over ``group_id``.

    The first filled value in precedence order wins. A conflict is a group whose smallest and
    largest comparison forms differ; it is silent when every source with a value is listed.
    Ties follow the order of arrival: an ``arrival`` column or ``source_order``, then the id.
    All measures are minima and maxima, so a group of any size is combined map-side.
    """
    rank = source_rank(entity.source_precedence, F.col("source_file"))
    listed_arrival = source_rank(source_order or (), F.col("source_file"))
    arrival = F.col("arrival") if "arrival" in members.columns else listed_arrival
    order = F.struct(rank.alias("rank"), arrival.alias("arrival"), F.col("record_id"))
    listed = rank < len(entity.source_precedence)
    ready = members.withColumns({"__order": order, "__listed": listed, "__first": F.struct(arrival, F.col("record_id"))})
    measures = [
        F.count(F.lit(1)).alias("n_members"),
        F.min_by("record_id", "__first").alias("primary_id"),
        F.array_sort(F.collect_set("source_file")).alias("source_files"),
    ]
    for i, name in enumerate(entity.names):
        held = F.col(column(name))
        value = F.when(filled(held), held)
        place = F.when(filled(held), F.col("__order"))
        form = conflict_key(value)
        measures += [
            F.min_by(value, place).alias(f"v{i}"),
            F.min(form).alias(f"lo{i}"),
            F.max(form).alias(f"hi{i}"),
            F.bool_and(F.when(filled(held), F.col("__listed"))).alias(f"listed{i}"),
        ]
    failed = "step_errors" in members.columns
    if failed:  # as many names as the contract has fields
        measures.append(F.array_distinct(F.flatten(F.collect_set(F.col("step_errors")["target_field"]))).alias("open_errors"))
    merged = ready.groupBy("group_id").agg(*measures)
    conflicts = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"lo{i}") != F.col(f"hi{i}"),
                    F.struct(F.lit(name).alias("field"), F.col(f"listed{i}").alias("silent")),
                )
                for i, name in enumerate(entity.names)
            ]
        )
    ).cast(CONFLICT)
    fields = [F.col(f"v{i}").alias(name) for i, name in enumerate(entity.columns)]
    out = merged.select("group_id", *fields, "n_members", "primary_id", "source_files", conflicts.alias("conflicts"), *(["open_errors"] if failed else []))
    return out.withColumn(
        "record_key", F.coalesce(record_key(entity, entity.columns), F.col("primary_id"))
    ).withColumn("open_conflicts", F.filter("conflicts", lambda c: ~c["silent"])["field"])


def conflict_values(members: DataFrame, merged: DataFrame, entity: Entity, rows: int | None = None) -> DataFrame:
    """(group_id, record_key, field, source_file, value, n_rows) behind every open conflict.

    Long form: a conflict over a huge group is as many rows as it has values, not one array.
    """
    disputed = merged.where(F.size("open_conflicts") > 0).select("group_id", "record_key", "open_conflicts")
    cells = F.array(*[F.struct(F.lit(n).alias("field"), F.col(column(n)).alias("value")) for n in entity.names])
    return (
        lookup_join(members, disputed, "group_id", rows)
        .where("open_conflicts is not null")
        .select("group_id", "record_key", "source_file", "open_conflicts", F.inline(cells))
        .where(F.array_contains("open_conflicts", F.col("field")) & filled(F.col("value")))
        .groupBy("group_id", "record_key", "field", "source_file", "value")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def corrections_wide(corrections: DataFrame, entity: Entity) -> DataFrame:
    """Latest filled correction per (record_key, field), one column per field."""
    usable = corrections.where((F.col("entity") == entity.name) & filled(F.col("value")))
    when = F.struct("decided_at", "decision_id")
    latest = [
        F.max_by(F.when(F.col("field") == n, F.col("value")), F.when(F.col("field") == n, when)).alias(f"fix_{n}")
        for n in entity.names
    ]
    return usable.groupBy("record_key").agg(*latest)


def apply_corrections(merged: DataFrame, corrections: DataFrame, entity: Entity) -> DataFrame:
    """Corrections replace merged values and settle the conflict of the same field."""
    joined = merged.join(corrections_wide(corrections, entity), "record_key", "left")
    fixed = F.array_compact(
        F.array(*[F.when(F.col(f"fix_{n}").isNotNull(), F.lit(n)) for n in entity.names])
    )
    return joined.withColumns(
        {column(n): F.coalesce(F.col(f"fix_{n}"), F.col(column(n))) for n in entity.names}
        | {"corrected": fixed, "open_conflicts": F.array_except("open_conflicts", fixed)}
        | ({"open_errors": F.array_except("open_errors", fixed)} if "open_errors" in joined.columns else {})
    ).drop(*[f"fix_{n}" for n in entity.names])


def correction_audit(corrected: DataFrame, entity: Entity) -> DataFrame:
    """(record_key, field, value) of every correction that was applied."""
    cells = F.array(*[F.struct(F.lit(n).alias("field"), F.col(column(n)).alias("value")) for n in entity.names])
    return (
        corrected.where(F.size("corrected") > 0)
        .select("record_key", "corrected", F.inline(cells))
        .where(F.array_contains("corrected", F.col("field")))
        .select("record_key", "field", "value")
    )


def member_status(members: DataFrame, groups: DataFrame, rows: int | None = None) -> DataFrame:
    """Status of every record: the first member of a good group goes to the target.

    ``groups`` has group_id, primary_id and ``group_status``; other members of a ready group
    are RECONCILED, members of a held group share its status.
    """
    joined = lookup_join(
        members.select("record_id", "group_id", "source_file", "source_row_number"),
        groups.select("group_id", "primary_id", "group_status", "record_key"),
        "group_id",
        rows,
    )
    first = F.col("record_id") == F.col("primary_id")
    status = F.when((F.col("group_status") == READY) & ~first, RECONCILED).otherwise(F.col("group_status"))
    return joined.withColumn("status", status).drop("primary_id", "group_status")


def duplicate_values(merged: DataFrame, entity: Entity) -> DataFrame:
    """(field, value, n_groups) of unique values that several surviving records share.

    Exact identity rules this out except for values brought in by corrections.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("field"), match_key(F.col(column(n))).alias("value")) for n in entity.unique_fields])
    return (
        merged.select(F.inline(cells))
        .where("value is not null")
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("n_groups"))
        .where("n_groups > 1")
    )
