"""The whole run: sources, contract and decisions in, records, reviews and audit out."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcemeld.contract import Contract, Entity, column, contract_fields
from sourcemeld.functions.steps import Chain, Step, run_chains
from sourcemeld.operators import identity, matching, planning, profile, review, survivorship, validation
from sourcemeld.operators.fuzzy import fuzzy_identity
from sourcemeld.operators.skew import sized_join
from sourcemeld.operators.standardise import Mapped, standardise_source, step_error_rows
from sourcemeld.session import Scratch
from sourcemeld.settings import (
    AMBIGUOUS_MAPPING,
    AMBIGUOUS_MATCH,
    ASK_CONFLICT,
    ASK_ENTITY,
    ASK_INVALID,
    ASK_MAPPING,
    ASK_MATCH,
    ASK_MISSING,
    ASK_REQUIRED,
    ASK_STEP,
    CONFLICTING_VALUES,
    INVALID_RECORD,
    NO_SAFE_SOURCE,
    UNMAPPED_VALUE,
)


@dataclass
class Decisions:
    """Accepted decisions as the operators use them; everything is optional."""

    accepted: DataFrame | None = None
    entity_choices: DataFrame | None = None
    proposals: DataFrame | None = None
    same: DataFrame | None = None
    apart: DataFrame | None = None


@dataclass
class EntityRun:
    entity: Entity
    records: DataFrame
    members: DataFrame
    merged: DataFrame
    status: DataFrame
    corrections: DataFrame


@dataclass
class Run:
    catalog: DataFrame
    entities: DataFrame
    mapping: DataFrame
    reviews: DataFrame
    audit: DataFrame
    unresolved: DataFrame
    #: Where the run ended: PROFILING and MAPPING if questions of that stage are open, else VALIDATING.
    stage: str = "VALIDATING"
    #: (entity, record_key, field, source_file, value, n_rows): the values behind open conflicts.
    conflict_values: DataFrame | None = None
    by_entity: dict[str, EntityRun] = field(default_factory=dict)


def run(
    spark: SparkSession,
    sources: list[DataFrame],
    contract: Contract,
    decisions: Decisions | None = None,
    names: list[str] | None = None,
    exacts: list[str] | None = None,
    gates: bool = False,
) -> Run:
    """A pure function of its inputs: running it again replays the decisions.

    With ``gates`` the run stops after the choice of entities, and again after mapping and standardising, if that stage has
    left questions open: what comes later would only ask about their consequences.

    ``sources`` are text frames with lineage columns, one per header. Only metadata comes to
    the driver: column types, mapping decisions and step plans. Standardised records are
    written once, because identity, survivorship and reviews all read them.
    """
    decisions = decisions or Decisions()
    _check_names(contract)
    scratch = Scratch(spark)
    # Each source is derived once; all later passes read its columns from the written table.
    sources = [scratch.write(s, f"source-{i}") for i, s in enumerate(sources)]
    seen = [profile.source_profile(s).withColumn("frame", F.lit(i)) for i, s in enumerate(sources)]
    catalog = scratch.write(reduce(DataFrame.unionByName, seen), "catalog")
    twice = catalog.groupBy("source_file").agg(F.count_distinct("frame").alias("n")).where("n > 1").select("source_file").limit(5).collect()
    if twice:
        raise ValueError(f"several sources hold files named {[r.source_file for r in twice]}; read them together, so that their folders tell them apart")
    fields = contract_fields(spark, contract)
    scores = scratch.write(matching.label_scores(matching.distinct_labels(catalog), contract), "scores")
    choices = _entity_choices(decisions)
    entities = scratch.write(matching.detect_entities(catalog, contract, scores, choices=choices), "entities")
    undecided = review.review_items(
        entities.where("entity is null"),
        reason_code=AMBIGUOUS_MAPPING,
        title=F.concat(F.lit(ASK_ENTITY), F.col("source_file")),
        source_file=F.col("source_file"),
        source_field=F.col("source_file"),  # one question per file
        candidates=F.array(*[F.lit(e.name) for e in contract.entities]),
    )
    nothing = spark.createDataFrame([], "action string, reason string, record_key string, data string")
    if gates and not entities.where("entity is null").isEmpty():
        return Run(catalog, entities, None, undecided, nothing, None, stage="PROFILING")
    overrides = None
    if decisions.accepted is not None:  # a target that the contract lacks overrides nothing
        told = review.mapping_overrides(decisions.accepted)
        overrides = told.join(F.broadcast(fields.select("entity", F.col("field").alias("target_field"))), ["entity", "target_field"], "left_semi").select(*told.columns)
    mapping = scratch.write(
        matching.decide_fields(
            matching.column_candidates(catalog, entities, matching.match_candidates(scores, contract)),
            decisions.proposals,
            overrides,
        ),
        "mapping",
    )
    gaps = matching.missing_required(mapping, fields, catalog, entities)
    items = [
        undecided,
        review.review_items(
            gaps,
            reason_code=AMBIGUOUS_MAPPING,
            entity=F.col("entity"),
            title=F.concat(F.lit(ASK_REQUIRED), F.col("target_field"), F.lit(NO_SAFE_SOURCE)),
            target_field=F.col("target_field"),
            available_source_fields=F.col("available_source_fields"),
        ),
    ]
    open_mappings = mapping.where("decision = 'review'").select(
        "entity", "source_file", "source_column", "alternatives", "best_field", F.lit(None).cast("string").alias("target_field"),
        F.array_compact(F.concat(F.array("best_field"), F.col("alternatives.field"))).alias("candidates"),
    )
    judged = matching.split_mapping_reviews(open_mappings, gaps)
    items.append(
        review.review_items(
            judged.where("not suppressed"),
            reason_code=AMBIGUOUS_MAPPING,
            entity=F.col("entity"),
            title=F.concat(F.lit(ASK_MAPPING), F.col("source_column")),
            source_file=F.col("source_file"),
            source_field=F.col("source_column"),
            candidates=F.col("candidates"),
        )
    )
    audit = [
        judged.where("suppressed").select(
            F.lit("AMBIGUITY_SUPPRESSED").alias("action"), F.col("source_column").alias("reason"),
            F.lit(None).cast("string").alias("record_key"), F.to_json("candidates").alias("data"),
        )
    ]
    shapes = scratch.write(_shapes(catalog, mapping), "shapes")
    found = _distinct_shapes(catalog, shapes)
    framed = []
    for shape in found:
        source = sources[shape.frame]
        if shape.n_files < shape.all_files:
            files = shapes.where((F.col("frame") == shape.frame) & (F.col("shape_id") == shape.shape_id))
            source = sized_join(source, files.select("source_file"), "source_file", shape.n_files, "left_semi")
        framed.append(source)
    plans, unresolved = _plan_columns(spark, found, framed, contract, decisions, scratch)
    out = Run(catalog, entities, mapping, None, None, unresolved)
    records: dict[str, list[DataFrame]] = {}
    for shape, source, mapped in zip(found, framed, plans):
        entity = contract.entity(shape.entity)
        frame = standardise_source(source, entity, mapped).withColumn("arrival", F.lit(shape.frame))
        records.setdefault(entity.name, []).append(frame)
    stacked = {name: scratch.write(reduce(DataFrame.unionByName, frames), f"records-{name}") for name, frames in records.items()}
    for name, rows in stacked.items():
        items.append(_step_items(rows, contract.entity(name)))
    if gates and not review.stack_reviews(items).isEmpty():
        out.reviews, out.audit, out.stage = review.stack_reviews(items), reduce(DataFrame.unionByName, audit), "MAPPING"
        return out
    disputed = []
    for name, rows in stacked.items():
        done = out.by_entity[name] = _reconcile(rows, contract.entity(name), decisions, scratch, items, audit, names, exacts)
        values = survivorship.conflict_values(done.members, done.merged, done.entity)
        disputed.append(values.select(F.lit(name).alias("entity"), "record_key", "field", "source_file", "value", "n_rows"))
    if disputed:
        out.conflict_values = reduce(DataFrame.unionByName, disputed)
    out.reviews = review.stack_reviews(items)
    out.audit = reduce(DataFrame.unionByName, audit)
    return out


def _entity_choices(decisions: Decisions) -> DataFrame | None:
    """(source_file, entity): choices that were handed in and those among the accepted decisions, the latest of each file."""
    if decisions.accepted is None:
        return decisions.entity_choices
    told = decisions.accepted.where((F.col("reason_code") == AMBIGUOUS_MAPPING) & F.col("entity").isNull() & F.col("target_field").isNotNull())
    told = told.groupBy(F.col("source_field").alias("source_file")).agg(F.max_by("target_field", F.struct("decided_at", "decision_id")).alias("entity"))
    if decisions.entity_choices is None:
        return told
    return told.unionByName(decisions.entity_choices.select("source_file", "entity").join(told, "source_file", "left_anti"))


def _check_names(contract: Contract) -> None:
    """Fields need columns of their own."""
    clashes = sorted(f"{e.name}.{n}" for e in contract.entities for n in e.names if e.columns.count(column(n)) > 1)
    if clashes:
        raise ValueError(f"contract fields {clashes} would share a column")


def _shapes(catalog: DataFrame, mapping: DataFrame) -> DataFrame:
    """(frame, source_file, entity, shape_id, columns, facts): which columns of a file feed which fields.

    Files of one header and mapping share a shape, so a folder of a million files is one plan.
    """
    column = F.struct("ordinal", "source_column", "target_field")
    known = catalog.select("source_file", F.col("column").alias("source_column"), "frame", *profile.FACTS)
    return (
        mapping.where("target_field is not null")
        .join(known, ["source_file", "source_column"])
        .groupBy("frame", "source_file", "entity")
        .agg(
            F.array_sort(F.collect_list(column)).alias("columns"),
            F.array_sort(F.collect_list(F.struct("ordinal", "source_column", "target_field", *profile.FACTS))).alias("facts"),
        )
        .withColumn("shape_id", F.sha2(F.to_json("columns"), 256))
    )


def _distinct_shapes(catalog: DataFrame, shapes: DataFrame) -> list:
    """Distinct shapes with their number of files and their facts; as many as there are headers, not files."""
    all_files = catalog.groupBy("frame").agg(F.count_distinct("source_file").alias("all_files"))
    key = ["frame", "entity", "shape_id"]
    shown = [F.bool_or(f"fact.{name}").alias(name) for name in profile.FACTS]
    facts = shapes.select(*key, F.explode("facts").alias("fact")).groupBy(*key, F.col("fact.source_column").alias("source_column")).agg(*shown)
    facts = facts.groupBy(*key).agg(F.collect_list(F.struct("source_column", *profile.FACTS)).alias("facts"))
    return (
        shapes.groupBy(*key)
        .agg(F.min("columns").alias("columns"), F.min("source_file").alias("first_file"), F.count(F.lit(1)).alias("n_files"))
        .join(all_files, "frame")
        .join(facts, key)
        .orderBy(*key)
        .collect()
    )


def _param(value: str | None):
    """Lists and maps among the parameters come as JSON text."""
    if value and value[0] in "[{":
        try:
            return json.loads(value)
        except ValueError:
            pass
    return value


def _plan_columns(spark, shapes, sources, contract, decisions, scratch) -> tuple[list[list[Mapped]], DataFrame]:
    """Steps of every mapped column of every shape, and the enumerated values that nothing settles.

    Facts come with the shapes. The distinct values of all enumerated columns are gathered in one job over the written
    sources and planned in one more, however many columns there are.
    """
    approved = {}
    if decisions.accepted is not None:  # as many as people have typed in
        for r in review.step_overrides(decisions.accepted).collect():
            approved[r.entity, r.source_column] = [Step(s.operation, {k: _param(v) for k, v in (s.params or {}).items()}) for s in r.steps]
    plans, owners, allowed, staged = [], {}, {}, []
    for shape, source in zip(shapes, sources):
        entity = contract.entity(shape.entity)
        facts = {f.source_column: f.asDict() for f in shape.facts}
        mapped, chains = [], {}
        for r in shape.columns:
            target = entity.field(r.target_field)
            proposed = approved.get((entity.name, r.source_column)) or planning.default_steps(target)
            steps = tuple(planning.plan_steps(target, facts[r.source_column], proposed))
            owner = None
            if target.enum_values:
                steps = tuple(s for s in steps if s.operation != "map_value")
                owner = len(owners)
                owners[owner] = entity.name, shape.first_file, r.source_column, r.target_field
                allowed[owner] = list(target.enum_values)
                chains[owner] = Chain(f"v{owner}", F.col(f"`{r.source_column}`"), steps)
            mapped.append((r.source_column, r.target_field, steps, owner))
        plans.append(mapped)
        if chains:
            done = run_chains(source, list(chains.values()), skip_missing=True)
            cells = [F.struct(F.lit(o).alias("owner"), F.when(F.col(f"v{o}__error").isNull(), F.col(f"v{o}__value")).alias("value")) for o in chains]
            staged.append(done.select(F.inline(F.array(*cells))).where("value <> ''").distinct())
    if not staged:
        nothing = "entity string, source_file string, source_field string, target_field string, unresolved_value string"
        return [[Mapped(c, t, s) for c, t, s, _ in mapped] for mapped in plans], spark.createDataFrame([], nothing)
    answers = None
    if decisions.accepted is not None:
        told = review.value_answers(decisions.accepted)
        asked = spark.createDataFrame([(o, e, c) for o, (e, _, c, _) in owners.items()], "owner int, entity string, source_column string")
        answers = told.join(F.broadcast(asked), ["entity", "source_column"]).select("owner", "value", "target")
    plan = scratch.write(planning.enum_plans(reduce(DataFrame.unionByName, staged), allowed, answers), "values")
    sizes = {r.owner: r["count"] for r in plan.groupBy("owner").count().collect()}
    out = [
        [Mapped(c, t, s) if o is None else Mapped(c, t, s, plan.where(F.col("owner") == o).drop("owner"), sizes.get(o, 0)) for c, t, s, o in mapped]
        for mapped in plans
    ]
    return out, planning.unresolved_reviews(plan, owners)


def _known(records: DataFrame, entity: Entity) -> DataFrame:
    """What tells a person which record a question is about."""
    return records.select(
        "record_id", "source_file",
        F.coalesce(identity.record_key(entity, records.columns), F.col("record_id")).alias("record_key"),
        identity.record_summary(entity, records.columns).alias("summary"),
    )


def _step_items(records: DataFrame, entity: Entity) -> DataFrame:
    """Review items of failed steps."""
    return review.enrich(
        review.review_items(
            step_error_rows(records),
            reason_code=F.col("reason_code"),
            entity=entity.name,
            title=F.concat(F.lit(ASK_STEP), F.col("source_field")),
            record_id=F.col("record_id"),
            source_file=F.col("source_file"),
            source_field=F.col("source_field"),
            target_field=F.col("target_field"),
            error=F.col("error"),
            allowed_values=_allowed(entity),
            unresolved_values=F.when(F.col("reason_code") == UNMAPPED_VALUE, F.array("value")),
        ),
        _known(records, entity),
    )


def _reconcile(records, entity, decisions, scratch, items, audit, names, exacts) -> EntityRun:
    spark = records.sparkSession
    rows = records.count()
    accepted = decisions.accepted
    known = _known(records, entity)
    same, apart = _pairs(decisions, entity)
    exact = scratch.write(identity.exact_identity(records, entity, scratch, same, rows), "exact")
    alone = records.join(exact.where("method = 'single'").select("record_id"), "record_id", "left_semi")
    fuzzy, unsure = fuzzy_identity(alone, scratch, names, exacts, apart)
    groups = exact.where("method = 'exact'").unionByName(fuzzy)
    members = scratch.write(records.join(groups, "record_id"), "members")
    items.append(
        review.enrich(
            review.review_items(
                unsure, reason_code=AMBIGUOUS_MATCH, entity=entity.name, title=ASK_MATCH,
                record_id=F.col("record_id"), candidates=F.array("partner"),
            ),
            known,
        )
    )
    merged = survivorship.merge_groups(members, entity)
    if accepted is not None:
        corrections = review.field_corrections(accepted)
    else:
        corrections = spark.createDataFrame(
            [], "entity string, record_key string, field string, value string, decided_at timestamp_ntz, decision_id string"
        )
    corrected = survivorship.apply_corrections(merged, corrections, entity)
    checked = scratch.write(validation.group_status(validation.validate(corrected, entity)), "merged")
    audit.append(
        survivorship.correction_audit(checked, entity).select(
            F.lit("CONFLICT_RESOLUTION_APPLIED").alias("action"),
            F.concat(F.lit("Applied decision for "), F.col("field")).alias("reason"),
            "record_key",
            F.col("value").alias("data"),
        )
    )
    summary = identity.record_summary(entity, entity.columns)
    items.append(
        review.review_items(
            checked.where(F.size("open_conflicts") > 0).select("*", F.explode("open_conflicts").alias("conflict")),
            reason_code=CONFLICTING_VALUES, entity=entity.name,
            title=F.concat(F.lit(ASK_CONFLICT), F.col("conflict")),
            record_id=F.col("primary_id"), record_key=F.col("record_key"), field=F.col("conflict"),
            source_file=F.element_at("source_files", 1), summary=summary,
        )
    )
    items.append(
        review.review_items(
            checked.where((F.size("open_conflicts") == 0) & (F.size("violations") > 0)),
            reason_code=INVALID_RECORD, entity=entity.name,
            title=F.concat(
                F.when(F.size(validation.missing_fields(F.col("violations"))) > 0, ASK_MISSING).otherwise(
                    ASK_INVALID
                ),
                F.col("record_key"),
            ),
            record_id=F.col("primary_id"), record_key=F.col("record_key"), violations=F.col("violations"),
            source_file=F.element_at("source_files", 1), summary=summary,
        )
    )
    status = survivorship.member_status(members, checked, rows).withColumn("entity", F.lit(entity.name))
    return EntityRun(entity, records, members, checked, status, corrections)


def _pairs(decisions: Decisions, entity: Entity) -> tuple[DataFrame | None, DataFrame | None]:
    """Pairs that are told to be the same and told to differ."""
    if decisions.accepted is None:
        return decisions.same, decisions.apart
    mine = decisions.accepted.where(F.col("entity") == entity.name)
    told = []
    for given, verdict in ((decisions.same, review.SAME), (decisions.apart, review.DIFFERENT)):
        pairs = review.pair_decisions(mine, verdict)
        told.append(pairs if given is None else pairs.unionByName(given.select("record_a", "record_b")))
    return told[0], told[1]


def _allowed(entity: Entity):
    choice = F.lit(None).cast("array<string>")
    for f in entity.fields:
        if f.enum_values:
            choice = F.when(F.col("target_field") == f.name, F.array(*[F.lit(v) for v in f.enum_values])).otherwise(choice)
    return choice
