"""Contract checks on canonical text, quarantine and typing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemeld.contract import Entity, Field, column
from sourcemeld.functions.text import is_missing
from sourcemeld.operators.profile import NUMBER
from sourcemeld.settings import IN_REVIEW, READY, SAY_ENUM, SAY_REQUIRED, SAY_TYPE

VIOLATION = "array<struct<field:string,code:string,message:string>>"

# Texts that are dates and timestamps in ISO form.
ISO_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
ISO_DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"


def type_ok(c: Column, data_type: str) -> Column:
    if data_type == "integer":
        return c.rlike("^[+-]?[0-9]+$") & c.try_cast("bigint").isNotNull()
    if data_type == "number":
        return c.rlike(NUMBER) & c.try_cast("double").isNotNull()
    if data_type == "boolean":
        return c.isin("true", "false")
    if data_type == "date":
        return c.rlike(ISO_DATE) & c.try_cast("date").isNotNull()
    if data_type == "datetime":
        return c.rlike(ISO_DATETIME) & c.try_cast("timestamp").isNotNull()
    if data_type in ("array", "object"):
        shape = r"^\s*\[" if data_type == "array" else r"^\s*\{"
        return c.rlike(shape) & F.try_parse_json(c).isNotNull()
    return F.lit(True)


def violation(field: Field) -> Column:
    """At most one violation per field: required, then enum, then type."""
    c = F.col(column(field.name))

    def found(code: str, message: str) -> Column:
        return F.struct(F.lit(field.name).alias("field"), F.lit(code).alias("code"), F.lit(message).alias("message"))

    check = F.when(is_missing(c), found("required", SAY_REQUIRED) if field.required else F.lit(None))
    if field.enum_values:
        check = check.when(~c.isin(*field.enum_values), found("enum", f"{SAY_ENUM} {list(field.enum_values)}"))
    return check.when(~type_ok(c, field.data_type), found("type", f"{SAY_TYPE} {field.data_type}"))


def validate(df: DataFrame, entity: Entity) -> DataFrame:
    """Adds ``violations`` in contract order; a valid record has none."""
    checks = F.array_compact(F.array(*[violation(f) for f in entity.fields])).cast(VIOLATION)
    return df.withColumn("violations", F.coalesce(checks, F.array().cast(VIOLATION)))


def missing_fields(violations: Column) -> Column:
    return F.filter(violations, lambda v: v["code"] == "required")["field"]


def violation_rows(validated: DataFrame, *keys: str) -> DataFrame:
    return validated.where(F.size("violations") > 0).select(*keys, F.inline("violations"))


def quarantine(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, held) by violations; both read the same plan."""
    return validated.where(F.size("violations") == 0), validated.where(F.size("violations") > 0)


def group_status(validated: DataFrame) -> DataFrame:
    held = (F.size("open_conflicts") > 0) | (F.size("violations") > 0)
    if "open_errors" in validated.columns:  # a field whose step failed, and that no correction has settled
        held = held | (F.size("open_errors") > 0)
    return validated.withColumn("group_status", F.when(held, IN_REVIEW).otherwise(READY))


TYPE_NAMES = {
    "string": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "date": "date",
    "datetime": "timestamp_ntz", "array": "array<string>", "object": "variant",
}


def as_typed(df: DataFrame, field: Field) -> Column:
    """A contract field in its own type: read from canonical text, or cast where it is no text."""
    name = column(field.name) if column(field.name) in df.columns else field.name
    c = F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")
    kind = TYPE_NAMES[field.data_type]
    if name in df.columns and df.schema[name].dataType.simpleString() not in ("string", "void"):
        return c if df.schema[name].dataType.simpleString() == kind else c.try_cast(kind)
    if field.data_type == "array":
        return F.from_json(c, kind)
    if field.data_type == "object":
        return F.try_parse_json(c)
    if field.data_type == "datetime":
        c = F.regexp_replace(c, r"(Z|[+-][0-9]{2}:[0-9]{2})$", "")
    return c.try_cast(kind)


def typed(df: DataFrame, entity: Entity, *others: str) -> DataFrame:
    """Contract fields as typed columns; call it on valid records."""
    return df.select(*others, *[as_typed(df, f).alias(f.name) for f in entity.fields])
