"""Review queue and decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemeld.functions.text import filled, meaningful_map, meaningful_text, meaningful_value, strip
from sourcemeld.operators.skew import sized_join, spread
from sourcemeld.settings import (
    AMBIGUOUS_MAPPING,
    AMBIGUOUS_MATCH,
    FIELD_LEVEL_REASONS,
    INVALID_RECORD,
    PROPOSER_UNAVAILABLE,
    UNMAPPED_VALUE,
)

# Answers to "is this record the same as its partner": value_map {partner: verdict}.
SAME, DIFFERENT = "same", "different"

REVIEW_COLUMNS = {
    "reason_code": "string",
    "entity": "string",
    "title": "string",
    "record_id": "string",
    "record_key": "string",
    "source_file": "string",
    "source_field": "string",
    "target_field": "string",
    "field": "string",
    "error": "string",
    "violations": "array<struct<field:string,code:string,message:string>>",
    "candidates": "array<string>",
    "available_source_fields": "array<string>",
    "allowed_values": "array<string>",
    "unresolved_values": "array<string>",
    "summary": "map<string,string>",
}

DECISION_COLUMNS = {
    "decision_id": "string",
    "review_id": "string",
    "reason_code": "string",
    "entity": "string",
    "record_id": "string",
    "record_key": "string",
    "source_field": "string",
    "target_field": "string",
    "corrections": "map<string,string>",
    "value_map": "map<string,string>",
    "steps": "array<struct<operation:string,params:map<string,string>>>",
    "actor": "string",
    "decided_at": "timestamp_ntz",
}


def review_items(df: DataFrame, **columns) -> DataFrame:
    """Bring rows into the common review shape; columns not given are null."""
    given = {k: v if isinstance(v, Column) else F.lit(v) for k, v in columns.items()}
    return df.select(
        *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in REVIEW_COLUMNS.items()]
    )


def stack_reviews(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def signature() -> Column:
    """What makes two review items the same question."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    codes = F.array_join(
        F.array_sort(F.transform("violations", lambda v: F.concat_ws(":", v["field"], v["code"]))), ","
    )
    parts = (
        F.when(
            F.col("reason_code").isin(*FIELD_LEVEL_REASONS),
            F.concat_ws("|", "reason_code", text("entity"), text("source_field"), text("target_field"), text("error")),
        )
        .when(F.col("reason_code") == INVALID_RECORD, F.concat_ws("|", "reason_code", text("entity"), F.coalesce(codes, F.lit(""))))
        .otherwise(
            F.concat_ws("|", "reason_code", text("entity"), text("record_id"), text("field"), text("source_field"))
        )
    )
    return F.sha2(parts, 256)


def with_review_id(items: DataFrame) -> DataFrame:
    return items.withColumn("review_id", signature())


def review_queue(items: DataFrame) -> DataFrame:
    """One open review per signature: its first item and the number of items behind it.

    What it stands for beside that is in long form: its records in ``review_members``, its unresolved values in ``review_values``.
    """
    signed = items if "review_id" in items.columns else with_review_id(items)
    order = F.struct(F.coalesce("source_file", F.lit("")), F.coalesce("record_id", F.lit("")), F.coalesce("record_key", F.lit("")))
    return (
        signed.groupBy("review_id")
        .agg(
            F.min_by(F.struct(*REVIEW_COLUMNS), order).alias("item"),
            F.count(F.lit(1)).alias("n_items"),
        )
        .select("review_id", "item.*", "n_items")
    )


def review_values(items: DataFrame) -> DataFrame:
    """(review_id, value): every value that a review asks about, in long form."""
    signed = items if "review_id" in items.columns else with_review_id(items)
    return signed.select("review_id", F.explode("unresolved_values").alias("value")).distinct()


def _unanswered(answers: DataFrame, values: DataFrame) -> DataFrame:
    """decision_id of answers (decision_id, review_id, allowed, given) that leave a value of their review without an allowed target.

    The values may be very many for few answers: those are sent to them while they are few, and their number is counted.
    """
    told = answers.where("review_id is not null").select("decision_id", "review_id", "allowed", "given")
    met = sized_join(values, told, "review_id", told.count(), "inner")
    target = strip(F.try_element_at("given", F.col("value")))
    return met.where(~F.coalesce(F.array_contains("allowed", target), F.lit(False))).select("decision_id").distinct()


def review_members(items: DataFrame) -> DataFrame:
    """(review_id, record_key, record_id): every record a review stands for, in long form."""
    signed = items if "review_id" in items.columns else with_review_id(items)
    return signed.where("record_key is not null or record_id is not null").select(
        "review_id", "record_key", "record_id"
    ).distinct()


def enrich(items: DataFrame, records: DataFrame) -> DataFrame:
    """Fill source file, key and summary from the record an item points at."""
    known = records.select(
        "record_id",
        F.col("source_file").alias("__file"),
        F.col("record_key").alias("__key"),
        F.col("summary").alias("__summary"),
    )
    return items.join(known, "record_id", "left").select(
        *[
            F.coalesce(F.col(n), F.col(f"__{short}")).alias(n)
            if (short := {"source_file": "file", "record_key": "key", "summary": "summary"}.get(n))
            else F.col(n)
            for n in items.columns
        ]
    )


def _empty(kind: str) -> Column:
    return F.array().cast("array<string>") if kind == "array" else F.create_map().cast("map<string,string>")


def check_decisions(decisions: DataFrame, queue: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Decisions with ``problem``: NULL for an accepted one, else why it was refused.

    The rules of the review's own kind are checked against its context: candidate targets,
    columns on offer, failing fields, allowed values for every unresolved value, which ``values`` (``review_values``) has. A
    decision for a review that is not open is refused as well.
    """
    if values is None:
        values = review_values(queue)
    context = queue.select(
        "review_id",
        F.lit(True).alias("open"),
        F.col("reason_code").alias("kind"),
        F.coalesce("candidates", _empty("array")).alias("candidates"),
        F.coalesce("available_source_fields", _empty("array")).alias("available"),
        F.coalesce("violations", F.array().cast(REVIEW_COLUMNS["violations"]))["field"].alias("failing"),
        F.coalesce("allowed_values", _empty("array")).alias("allowed"),
        F.col("target_field").alias("context_target"),
    )
    d = decisions.join(context, "review_id", "left")
    asked = d.where(F.col("kind") == UNMAPPED_VALUE).select("decision_id", "review_id", "allowed", F.coalesce("value_map", _empty("map")).alias("given"))
    d = d.join(_unanswered(asked, values).withColumn("unanswered", F.lit(True)), "decision_id", "left")
    corrections = F.coalesce("corrections", _empty("map"))
    answers = F.coalesce("value_map", _empty("map"))
    says_nothing = (
        ~meaningful_text(F.col("target_field"))
        & ~meaningful_text(F.col("source_field"))
        & ~meaningful_map(corrections)
        & ~meaningful_map(answers)
        & (F.coalesce(F.size("steps"), F.lit(0)) <= 0)
    )
    named = F.coalesce(F.col("steps")["operation"], _empty("array"))
    blank_operation = F.exists(named, lambda o: ~meaningful_text(o))
    target = F.coalesce("target_field", "context_target")
    mapping_kind = F.col("kind") == AMBIGUOUS_MAPPING
    record_kind = F.col("kind") == INVALID_RECORD
    value_kind = F.col("kind") == UNMAPPED_VALUE
    pair_kind = F.col("kind") == AMBIGUOUS_MATCH
    stray_field = (F.size("failing") > 0) & F.exists(F.map_keys(corrections), lambda k: ~F.array_contains("failing", k))
    blank_fix = F.exists(F.map_values(corrections), lambda v: ~meaningful_text(v))
    unanswered = F.coalesce("unanswered", F.lit(False))
    problem = (
        F.when(F.col("open").isNull(), "review is not open")
        .when(says_nothing, "decision is empty")
        .when(blank_operation, "an operation is empty")
        .when(
            mapping_kind & filled(target) & (F.size("candidates") > 0) & ~F.array_contains("candidates", target),
            "target is not a candidate",
        )
        .when(
            mapping_kind & (F.size("available") > 0)
            & ~F.coalesce(F.array_contains("available", F.col("source_field")), F.lit(False)),
            "source column is not on offer",
        )
        .when((F.col("kind") == PROPOSER_UNAVAILABLE) & ~meaningful_text(F.col("target_field")), "a mapping is needed")
        .when(record_kind & (F.size(corrections) <= 0), "a correction is needed")
        .when(record_kind & stray_field, "field is not failing")
        .when(record_kind & blank_fix, "a correction is empty")
        .when(pair_kind & ~F.forall(F.map_values(answers), lambda v: v.isin(SAME, DIFFERENT)), "a pair is same or different")
        .when(pair_kind & F.exists(F.map_keys(answers), lambda k: ~F.array_contains("candidates", k)), "record is not the partner")
        .when(value_kind & (unanswered | (F.size(answers) <= 0)), "a value has no allowed target")
    )
    return d.withColumn("problem", problem).select(*decisions.columns, "problem")


RESOLUTION_COLUMNS = {
    "decision_id": "string", "review_id": "string", "record_key": "string", "actor": "string", "decided_at": "timestamp_ntz", "resolution": "variant",
}
_STEPS = "array<struct<operation:string,params:map<string,variant>>>"
_MAPPINGS = f"array<struct<source_field:string,target_field:string,transformations:{_STEPS}>>"


def _kind(path: str) -> Column:
    """Kind of a part of the resolution: STRING, ARRAY, OBJECT, ...; VOID for a JSON null, NULL where it is not there."""
    return F.regexp_extract(F.schema_of_variant(F.variant_get("resolution", path, "variant")), "^[A-Z]+", 0)


def _items(path: str) -> Column:
    return F.coalesce(F.try_variant_get("resolution", path, "array<variant>"), F.array().cast("array<variant>"))


def _text(item: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(item, f"$.{name}", "string"), F.lit(""))


def check_resolutions(resolutions: DataFrame, queue: DataFrame, values: DataFrame) -> DataFrame:
    """Typed answers (``RESOLUTION_COLUMNS``) with ``problem``: NULL for an accepted one, else why it was refused.

    A resolution is a VARIANT object as people or models send it: target_field, source_field, corrections, transformations (a list of
    operation and params, which may hold lists and maps) and mappings (a list, each with fields and transformations of its own). Its shape
    is checked first, then what the open review allows: candidates, columns on offer, failing fields, and for unmapped values a
    map_value step that settles each of ``values`` (``review_values``).
    """
    context = queue.select(
        "review_id", F.lit(True).alias("open"), F.col("reason_code").alias("kind"), F.coalesce("candidates", _empty("array")).alias("candidates"),
        F.coalesce("available_source_fields", _empty("array")).alias("available"), F.coalesce("violations", F.array().cast(REVIEW_COLUMNS["violations"]))["field"].alias("failing"),
        F.coalesce("allowed_values", _empty("array")).alias("allowed"), F.col("target_field").alias("context_target"),
    )
    steps, mappings = _items("$.transformations"), _items("$.mappings")

    def nameless(listed: Column) -> Column:
        return F.exists(listed, lambda x: ~meaningful_text(_text(x, "operation")))

    half = F.exists(mappings, lambda m: ~meaningful_text(_text(m, "source_field")) | ~meaningful_text(_text(m, "target_field")))
    own_steps = F.flatten(F.transform(mappings, lambda m: F.coalesce(F.try_variant_get(m, "$.transformations", "array<variant>"), F.array().cast("array<variant>"))))
    listed = lambda path, items: (_kind(path) == "ARRAY") & (F.size(items) > 0)
    map_steps = F.filter(steps, lambda x: _text(x, "operation") == "map_value")
    given = F.try_variant_get(F.element_at(map_steps, -1), "$.params.mapping", "map<string,string>")
    corrections = F.try_variant_get("resolution", "$.corrections", "map<string,variant>")
    d = spread(resolutions, "decision_id").join(context, "review_id", "left").withColumn("given", F.when(F.size(map_steps) > 0, given))
    asked = d.where(F.col("kind") == UNMAPPED_VALUE).select("decision_id", "review_id", "allowed", F.coalesce("given", _empty("map")).alias("given"))
    d = d.join(_unanswered(asked, values).withColumn("unanswered", F.lit(True)), "decision_id", "left")
    target = F.coalesce(F.try_variant_get("resolution", "$.target_field", "string"), F.col("context_target"))
    source = F.try_variant_get("resolution", "$.source_field", "string")
    on = lambda reason: F.col("kind") == reason
    blank_fix = F.exists(F.map_values(corrections), lambda v: F.coalesce(F.is_variant_null(v), F.lit(True)) | ((F.schema_of_variant(v) == "STRING") & ~meaningful_text(F.try_variant_get(v, "$", "string"))))
    problem = (
        F.when(F.col("open").isNull(), "review is not open")
        .when(F.coalesce(_kind("$") != "OBJECT", F.lit(True)) | ~meaningful_value(F.col("resolution")), "decision is empty")
        .when(_kind("$.target_field").isNotNull() & ((_kind("$.target_field") != "STRING") | ~meaningful_text(target)), "target is no text")
        .when(_kind("$.transformations").isNotNull() & ~listed("$.transformations", steps), "steps are no list")
        .when(nameless(steps), "an operation is empty")
        .when(_kind("$.mappings").isNotNull() & ~listed("$.mappings", mappings), "mappings are no list")
        .when(half, "a mapping is incomplete")
        .when(nameless(own_steps), "an operation is empty")
        .when(on(AMBIGUOUS_MAPPING) & filled(target) & (F.size("candidates") > 0) & ~F.array_contains("candidates", target), "target is not a candidate")
        .when(on(AMBIGUOUS_MAPPING) & (F.size("available") > 0) & ~F.coalesce(F.array_contains("available", source), F.lit(False)), "source column is not on offer")
        .when(on(PROPOSER_UNAVAILABLE) & (F.size(mappings) == 0) & _kind("$.target_field").isNull(), "a mapping is needed")
        .when(on(INVALID_RECORD) & (F.coalesce(F.size(corrections), F.lit(0)) <= 0), "a correction is needed")
        .when(on(INVALID_RECORD) & (F.size("failing") > 0) & F.exists(F.map_keys(corrections), lambda k: ~F.array_contains("failing", k)), "field is not failing")
        .when(on(INVALID_RECORD) & blank_fix, "a correction is empty")
        .when(on(UNMAPPED_VALUE) & (F.col("given").isNull() | F.coalesce("unanswered", F.lit(False))), "a value has no allowed target")
    )
    return d.withColumn("problem", problem).select(*resolutions.columns, "problem")


def decisions_of(accepted: DataFrame, queue: DataFrame) -> DataFrame:
    """Accepted resolutions as decision rows (``DECISION_COLUMNS``): one per mapping and one for everything else it says.

    Parameters that are lists or maps are kept as their JSON text.
    """
    context = queue.select("review_id", "reason_code", "entity", "record_id", F.col("source_field").alias("asked_source"), F.col("target_field").alias("asked_target"), F.col("record_key").alias("asked_key"))
    # Where all answers are to one review, the planner drops the key; a counted queue keeps that from pairing every partition with every other.
    d = sized_join(accepted, context, "review_id", queue.count(), "inner")

    def steps(of: Column) -> Column:
        return F.transform(
            of,
            lambda x: F.struct(
                _text(x, "operation").alias("operation"),
                F.transform_values(
                    F.coalesce(F.try_variant_get(x, "$.params", "map<string,variant>"), F.create_map().cast("map<string,variant>")),
                    lambda _, v: F.coalesce(F.when(F.schema_of_variant(v).rlike("^(ARRAY|OBJECT)"), F.to_json(v)), F.try_variant_get(v, "$", "string")),
                ).alias("params"),
            ),
        ).cast(DECISION_COLUMNS["steps"])

    own = _items("$.transformations")
    map_steps = F.filter(own, lambda x: _text(x, "operation") == "map_value")
    value_map = F.when((F.col("reason_code") == UNMAPPED_VALUE) & (F.size(map_steps) > 0), F.try_variant_get(F.element_at(map_steps, -1), "$.params.mapping", "map<string,string>"))
    whole = F.struct(
        F.coalesce(F.try_variant_get("resolution", "$.source_field", "string"), "asked_source").alias("source_field"),
        F.coalesce(F.try_variant_get("resolution", "$.target_field", "string"), "asked_target").alias("target_field"),
        F.try_variant_get("resolution", "$.corrections", "map<string,string>").alias("corrections"),
        value_map.alias("value_map"),
        F.when(F.col("reason_code") != UNMAPPED_VALUE, steps(own)).alias("steps"),
    )
    each = F.transform(
        _items("$.mappings"),
        lambda m: F.struct(
            _text(m, "source_field").alias("source_field"), _text(m, "target_field").alias("target_field"), F.lit(None).cast("map<string,string>").alias("corrections"),
            F.lit(None).cast("map<string,string>").alias("value_map"), steps(F.coalesce(F.try_variant_get(m, "$.transformations", "array<variant>"), F.array().cast("array<variant>"))).alias("steps"),
        ),
    )
    rows = d.withColumn("said", F.explode(F.concat(F.array(whole), each))).withColumn("record_key", F.coalesce("record_key", "asked_key"))
    flat = rows.select("decision_id", "review_id", "reason_code", "entity", "record_id", "record_key", "actor", "decided_at", "said.*")
    return flat.select(*[F.col(n).cast(t).alias(n) for n, t in DECISION_COLUMNS.items()])


def split_decisions(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused)."""
    return checked.where("problem is null").drop("problem"), checked.where("problem is not null")


def open_reviews(queue: DataFrame, accepted: DataFrame, members: DataFrame) -> DataFrame:
    """Reviews of the queue that nobody, or nobody for one of their records, has answered.

    ``members`` (review_id, record_key, ...) are the records behind the reviews. An answer closes its
    review for its own record; an answer without a record closes it for all. A review without
    records is closed by any answer.
    """
    answered = accepted.select("review_id", "record_key").distinct()
    records = members.where("record_key is not null").select("review_id", "record_key").distinct()
    waiting = records.join(answered, ["review_id", "record_key"], "left_anti").select("review_id")
    bare = queue.join(records, "review_id", "left_anti").join(answered, "review_id", "left_anti").select("review_id")
    closed = answered.where("record_key is null").select("review_id")
    return queue.join(waiting.unionByName(bare).distinct(), "review_id", "left_semi").join(closed, "review_id", "left_anti")


def review_states(earlier: DataFrame, queue: DataFrame, accepted: DataFrame) -> DataFrame:
    """(review_id, reason_code, state) over two runs: OPEN, RESOLVED or SUPERSEDED.

    A re-run replaces the open reviews; those that do not come back and were not answered are
    superseded.
    """
    known = earlier.select("review_id", "reason_code").unionByName(queue.select("review_id", "reason_code")).distinct()
    answered = accepted.select("review_id").distinct().withColumn("__answered", F.lit(True))
    current = queue.select("review_id").distinct().withColumn("__open", F.lit(True))
    state = F.when(F.col("__answered"), "RESOLVED").when(F.col("__open"), "OPEN").otherwise("SUPERSEDED")
    return (
        known.join(answered, "review_id", "left")
        .join(current, "review_id", "left")
        .select("review_id", "reason_code", state.alias("state"))
    )


def decision_log(accepted: DataFrame) -> DataFrame:
    """Audit rows of resolved reviews."""
    return accepted.select(
        "decided_at", "actor", F.lit("ESCALATION_RESOLVED").alias("action"), F.col("reason_code").alias("reason"),
        "review_id", "record_key",
    )


# --- what accepted decisions mean for the next run --------------------------------------


def _latest(accepted: DataFrame, keys: list[str], value: str) -> DataFrame:
    return accepted.groupBy(*keys).agg(F.max_by(value, F.struct("decided_at", "decision_id")).alias(value))


def mapping_overrides(accepted: DataFrame) -> DataFrame:
    """(entity, source_column, target_field): the latest approved mapping."""
    usable = accepted.where(filled(F.col("source_field")) & filled(F.col("target_field")))
    return _latest(usable, ["entity", "source_field"], "target_field").withColumnRenamed("source_field", "source_column")


def step_overrides(accepted: DataFrame) -> DataFrame:
    """(entity, source_column, steps): the latest approved steps."""
    usable = accepted.where(filled(F.col("source_field")) & (F.size("steps") > 0))
    return _latest(usable, ["entity", "source_field"], "steps").withColumnRenamed("source_field", "source_column")


def value_answers(accepted: DataFrame) -> DataFrame:
    """(entity, source_column, value, target): the latest approved value mappings."""
    rows = accepted.where("value_map is not null").select(
        "entity", "source_field", "decided_at", "decision_id", F.explode("value_map").alias("value", "target")
    )
    return _latest(rows, ["entity", "source_field", "value"], "target").withColumnRenamed("source_field", "source_column")


def field_corrections(accepted: DataFrame) -> DataFrame:
    """(entity, record_key, field, value, decided_at, decision_id) of record-level decisions."""
    return (
        accepted.where(F.col("reason_code").isin(INVALID_RECORD, "conflicting_values") & F.col("record_key").isNotNull())
        .select("entity", "record_key", "decided_at", "decision_id", F.explode("corrections").alias("field", "value"))
        .where(filled(F.col("value")))
    )


def pair_decisions(accepted: DataFrame, verdict: str) -> DataFrame:
    """(record_a, record_b) of the latest verdicts on doubtful pairs."""
    told = accepted.where(F.col("reason_code") == AMBIGUOUS_MATCH).select(
        F.col("record_id").alias("record_a"), "decided_at", "decision_id", F.explode("value_map").alias("record_b", "verdict")
    )
    return _latest(told, ["record_a", "record_b"], "verdict").where(F.col("verdict") == verdict).select("record_a", "record_b")
