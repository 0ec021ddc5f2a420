"""Which records stand for the same thing: exact identity on unique fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemeld.contract import Entity, column
from sourcemeld.functions.text import blank_to_null, filled, match_key, match_text, strip
from sourcemeld.operators.components import connected_components
from sourcemeld.operators.skew import lookup_join
from sourcemeld.session import Scratch

# Fields that can name a record when no unique field is filled.
FALLBACK_KEYS = ("employee_id", "id", "record_id")
SUMMARY_FIELDS = ("first_name", "last_name", "email", "name")
GENERIC_SUMMARY_FIELDS = ("employee_id", "id", "record_id", "first_name", "last_name", "email", "name")


def identity_keys(records: DataFrame, fields: list[str]) -> DataFrame:
    """(record_id, key) for every filled unique field; the field's place keeps fields apart."""
    keys = F.array(*[F.concat(F.lit(f"{i}:"), match_text(F.col(column(f)))) for i, f in enumerate(fields)])
    return records.select("record_id", F.explode(keys).alias("key")).where("length(key) > instr(key, ':')")


def star_edges(keys: DataFrame, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """(a, b): each record of a shared key tied to the smallest record of that key, never all pairs."""
    shared = keys.groupBy("key").agg(F.min("record_id").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    centres = scratch.write(shared, "centres")
    return (
        lookup_join(keys, centres, "key", rows, counted="n")
        .where("centre is not null and record_id <> centre")
        .select(F.col("record_id").alias("a"), F.col("centre").alias("b"))
    )


def exact_identity(
    records: DataFrame, entity: Entity, scratch: Scratch, same: DataFrame | None = None, rows: int | None = None
) -> DataFrame:
    """(record_id, group_id, method) for all records; a shared unique value joins, transitively.

    ``same`` (record_a, record_b) are approved pair decisions and count as edges.
    """
    ids = records.select("record_id")
    edges = []
    if entity.unique_fields:
        known = None if rows is None else rows * len(entity.unique_fields)
        edges.append(star_edges(identity_keys(records, entity.unique_fields), scratch, known))
    if same is not None:
        edges.append(same.select(F.col("record_a").alias("a"), F.col("record_b").alias("b")))
    if not edges:
        return ids.select("record_id", F.col("record_id").alias("group_id"), F.lit("single").alias("method"))
    labels = connected_components(reduce(DataFrame.unionByName, edges), scratch)
    return ids.join(labels.withColumnRenamed("node", "record_id"), "record_id", "left").select(
        "record_id",
        F.coalesce("root", "record_id").alias("group_id"),
        F.when(F.col("root").isNotNull(), "exact").otherwise("single").alias("method"),
    )


def group_evidence(members: DataFrame, entity: Entity) -> DataFrame:
    """(group_id, n_members, matched_fields): unique fields with exactly one distinct value.

    One distinct value means smallest = largest, so no set of values is built.
    """
    sides, tests = [], []
    for i, name in enumerate(entity.unique_fields):
        key = match_key(F.col(column(name)))
        sides += [F.min(key).alias(f"lo{i}"), F.max(key).alias(f"hi{i}")]
        tests.append(F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.lit(name)))
    matched = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return (
        members.groupBy("group_id")
        .agg(F.count(F.lit(1)).alias("n_members"), F.first("method").alias("method"), *sides)
        .select(
            "group_id",
            "n_members",
            "method",
            F.when(F.col("method") == "exact", matched).otherwise(F.array().cast("array<string>")).alias("matched_fields"),
        )
    )


def record_key(entity: Entity, columns: list[str]) -> Column:
    """First filled unique field, then a common id field; trimmed text."""
    order = [f for f in entity.unique_fields if column(f) in columns] + [k for k in FALLBACK_KEYS if k in entity.names and column(k) in columns]
    if not order:
        return F.lit(None).cast("string")
    return F.coalesce(*[strip(blank_to_null(F.col(column(c)))) for c in order])


def record_summary(entity: Entity, columns: list[str]) -> Column:
    """Short map that lets a person recognise a record; filled fields only."""

    def pick(names) -> Column:
        names = list(dict.fromkeys(n for n in names if (column(n) if n in entity.names else n) in columns))
        if not names:
            return F.create_map().cast("map<string,string>")
        pairs = F.create_map(*[x for n in names for x in (F.lit(n), F.col(column(n) if n in entity.names else n))])
        return F.map_filter(pairs, lambda _, v: filled(v))

    own = pick([*entity.unique_fields, *[n for n in SUMMARY_FIELDS if n in entity.names]])
    return F.when(F.size(own) > 0, own).otherwise(pick(GENERIC_SUMMARY_FIELDS))


def orphans(child: DataFrame, parent: DataFrame, field: str, references: str) -> DataFrame:
    """Child rows whose filled reference is not found in the parent."""
    known = parent.select(match_key(F.col(references)).alias("__key")).where("__key is not null").distinct()
    return (
        child.withColumn("__key", match_key(F.col(field)))
        .where("__key is not null")
        .join(known, "__key", "left_anti")
        .drop("__key")
    )
