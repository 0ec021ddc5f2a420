"""Which entity a source holds and which field a column feeds.

Works on a catalog (source_file, column, ordinal, inferred_type), one row per column of
every source. Scores are computed once per distinct label, then joined back, so a million
files with the same header cost one header. The contract is driver-side metadata and enters
as a literal array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcemeld.contract import Contract, Entity, Field
from sourcemeld.functions.policy import clear_score, types_compatible
from sourcemeld.functions.similarity import cosine, lexical_score
from sourcemeld.functions.text import exact_label, label, sql_text, squeeze, tokens
from sourcemeld.operators.skew import spread
from sourcemeld.settings import (
    AUTO_MARGIN,
    AUTO_SCORE,
    COVERED_SCORE,
    FALLBACK_SCORE,
    PLAUSIBLE_SCORE,
    TOP_CANDIDATES,
    UNCERTAIN_MARGIN,
    VECTOR_MARGIN,
)

# Words that place a label in a domain.
DOMAIN_WORDS = {
    "identifier": ("id", "identifier", "number", "no", "code", "key"),
    "name": ("name", "given", "first", "last", "surname", "family", "fname"),
    "email": ("email", "mail"),
    "phone": ("phone", "mobile", "telephone", "tel", "contact"),
    "date": ("date", "dob", "birth", "birthday", "joining", "doj", "hire", "start", "joined"),
    "status": ("status", "state", "active", "inactive"),
    "type": ("type", "kind", "category"),
    "organization": ("department", "dept", "team", "org", "organisation", "division", "unit", "business"),
}
# Domain pairs (source, target) that speak against or for a match.
INCOMPATIBLE = (
    ("name", "identifier"), ("identifier", "name"), ("email", "phone"), ("phone", "email"),
    ("date", "identifier"), ("date", "status"), ("type", "status"),
)
ALIGNED = ("identifier", "name", "email", "phone", "date", "organization", "status")
NAME_PART_WORDS = ("first", "last", "given", "surname", "family", "fname")
NAME_PARTS_OF_CONTRACT = ("first", "last", "given", "surname", "family")
DISJOINT_FACTOR, NAME_FACTOR, INCOMPATIBLE_FACTOR, ALIGNED_BONUS = 0.15, 0.55, 0.42, 0.08


def _text_array(values) -> Column:
    return F.expr(_sql_array(values))


def domains(words: Column) -> Column:
    """Domains that share a word with the given word list."""
    return F.array_compact(
        F.array(*[F.when(F.arrays_overlap(words, _text_array(w)), F.lit(d)) for d, w in DOMAIN_WORDS.items()])
    )


def _words(*texts: str) -> set[str]:
    return {w for t in texts for w in t.lower().translate(str.maketrans("_-/", "   ")).split()}


def _field_words(f: Field) -> set[str]:
    return _words(f.name, f.description, *f.aliases)


def _name_parts(entity: Entity) -> int:
    return sum(bool(_field_words(f) & set(NAME_PARTS_OF_CONTRACT)) for f in entity.fields)


def _sql_array(values) -> str:
    return f"cast(array({', '.join(sql_text(v) for v in values)}) as array<string>)"


def contract_labels(contract: Contract) -> Column:
    """Literal array with one struct per name and alias of every field."""
    rows = []
    for i, e in enumerate(contract.entities):
        for k, f in enumerate(e.fields):
            for text in (f.name, *f.aliases):
                plain = " ".join(text.replace("_", " ").replace("-", " ").split()).lower()
                rows.append(
                    f"named_struct('entity', {sql_text(e.name)}, 'entity_ordinal', {i}, 'field', {sql_text(f.name)}, "
                    f"'field_ordinal', {k}, 'target_label', {sql_text(plain)})"
                )
    return F.expr(f"array({', '.join(rows)})")


def label_scores(labels: DataFrame, contract: Contract) -> DataFrame:
    """(query, entity, field, raw_score, exact): best score over a field's name and aliases.

    ``labels`` has one column ``query`` with distinct labels in ``exact_label`` form.
    """
    pairs = (
        spread(labels, "query").select("query", squeeze(F.col("query")).alias("query_label"))
        .select("query", "query_label", F.inline(contract_labels(contract)))
    )
    scored = pairs.withColumn("score", lexical_score(F.col("query_label"), F.col("target_label")))
    return scored.groupBy("query", "entity", "entity_ordinal", "field", "field_ordinal").agg(
        F.max(F.when(F.col("query_label") == F.col("target_label"), 1.0).otherwise(F.col("score"))).alias("raw_score"),
        F.bool_or(F.col("query_label") == F.col("target_label")).alias("exact"),
    )


def distinct_labels(catalog: DataFrame) -> DataFrame:
    return catalog.select(exact_label(F.col("column")).alias("query")).distinct()


def rerank_by_vectors(scores: DataFrame, contract: Contract, vectors: DataFrame) -> DataFrame:
    """Raise unclear scores to the cosine of caller-supplied label vectors.

    ``vectors`` is (label, vector) in ``exact_label``/``label`` form. A label with an exact
    match or a clear lexical winner is left alone, so only undecided labels reach the join.
    """
    order = Window.partitionBy("query", "entity").orderBy(F.desc("raw_score"), "field_ordinal")
    whole = Window.partitionBy("query", "entity")
    marked = scores.withColumns(
        {
            "second": F.coalesce(F.nth_value("raw_score", 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0)),
            "top": F.max("raw_score").over(whole),
            "any_exact": F.bool_or("exact").over(whole),
        }
    ).withColumn("clear", F.col("any_exact") | clear_score(F.col("top"), F.col("top") - F.col("second")))
    unclear = marked.where(~F.col("clear"))
    targets = unclear.select("query", "entity", "field").join(
        unclear.sparkSession.createDataFrame(
            [(e.name, f.name, t) for e in contract.entities for f in e.fields for t in (f.name, *f.aliases)],
            "entity string, field string, text string",
        ),
        ["entity", "field"],
    )
    query_vec = vectors.select(F.col("label").alias("query"), F.col("vector").alias("query_vector"))
    target_vec = vectors.select(F.col("label").alias("target_label"), F.col("vector").alias("target_vector"))
    near = (
        targets.withColumn("target_label", label(F.col("text")))
        .join(query_vec, "query")
        .join(target_vec, "target_label")
        .groupBy("query", "entity", "field")
        .agg(F.max(cosine(F.col("query_vector"), F.col("target_vector"))).alias("near"))
    )
    return (
        marked.join(near, ["query", "entity", "field"], "left")
        .withColumn("raw_score", F.when(F.col("clear"), F.col("raw_score")).otherwise(F.greatest("raw_score", F.coalesce("near", F.lit(0.0)))))
        .select(*scores.columns)
    )


# --- entity detection -------------------------------------------------------------------


def entity_description(entity: Entity) -> str:
    parts = [entity.name, entity.description, *entity.names]
    parts += [f.description for f in entity.fields if f.description]
    parts += [a for f in entity.fields for a in f.aliases]
    return " | ".join(parts)


def entity_scores(catalog: DataFrame, contract: Contract, scores: DataFrame | None = None) -> DataFrame:
    """(source_file, entity, score): mean field score, share of covered columns, file name."""
    return _profiled(catalog, contract, scores).select("source_file", F.inline("ranked")).select("source_file", "entity", "entity_ordinal", "score")


def _profiled(catalog: DataFrame, contract: Contract, scores: DataFrame | None = None) -> DataFrame:
    """(source_file, ranked): one row per file, its entities from the best score down.

    A label carries its best score under every entity, so a file is one group of as many sums as the contract has entities.
    """
    scores = label_scores(distinct_labels(catalog), contract) if scores is None else scores
    held = range(len(contract.entities))
    best = scores.groupBy("query").agg(*[F.max(F.when(F.col("entity_ordinal") == i, F.col("raw_score"))).alias(f"best{i}") for i in held])
    per_file = (
        catalog.select("source_file", exact_label(F.col("column")).alias("query"))
        .join(best, "query")
        .groupBy("source_file")
        .agg(
            *[F.avg(f"best{i}").alias(f"mean{i}") for i in held],
            *[F.avg((F.col(f"best{i}") >= COVERED_SCORE).cast("double")).alias(f"covered{i}") for i in held],
        )
    )
    judged = []
    for i, entity in enumerate(contract.entities):
        named = F.contains(label(F.col("source_file")), label(F.lit(entity.name)))
        score = F.least(F.lit(1.0), 0.55 * F.col(f"mean{i}") + 0.39 * F.col(f"covered{i}") + F.when(named, 0.06).otherwise(0.0))
        scored = F.struct(F.round(score, 4).alias("score"), F.lit(-i).alias("place"), F.lit(i).alias("entity_ordinal"), F.lit(entity.name).alias("entity"))
        judged.append(F.when(F.col(f"mean{i}").isNotNull(), scored))
    return per_file.select("source_file", F.sort_array(F.array_compact(F.array(*judged)), asc=False).alias("ranked"))


def detect_entities(
    catalog: DataFrame,
    contract: Contract,
    scores: DataFrame | None = None,
    vectors: DataFrame | None = None,
    choices: DataFrame | None = None,
) -> DataFrame:
    """(source_file, entity, score, margin, decision); ``review`` rows have no entity.

    Ladder: only entity of the contract, clear profile score, clear description score, best
    plausible description, review. ``vectors`` (text, vector) refine the description tier,
    ``choices`` (source_file, entity) are outside answers for undecided files.
    """
    files = catalog.select("source_file").distinct()
    if len(contract.entities) == 1:
        return files.select(
            "source_file",
            F.lit(contract.entities[0].name).alias("entity"),
            F.lit(1.0).alias("score"),
            F.lit(1.0).alias("margin"),
            F.lit("only").alias("decision"),
        )
    first, second = F.try_element_at("ranked", F.lit(1)), F.try_element_at("ranked", F.lit(2))
    ranked = _profiled(catalog, contract, scores).where(F.size("ranked") > 0).select(
        "source_file", first["entity"].alias("entity"), first["score"].alias("score"),
        (first["score"] - F.coalesce(second["score"], F.lit(0.0))).alias("margin"),
    )
    clear = (F.col("score") >= AUTO_SCORE) | (F.col("margin") >= AUTO_MARGIN)
    settled = ranked.where(clear).withColumn("decision", F.lit("auto"))
    undecided = ranked.where(~clear).select("source_file")
    texts = (
        catalog.join(undecided, "source_file", "left_semi")
        .groupBy("source_file")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "column"))).alias("columns"))
        .withColumn("text", F.concat_ws(" | ", "source_file", F.col("columns.column")))
        .select("source_file", "text")
    )
    described = F.array(
        *[
            F.struct(F.lit(e.name).alias("entity"), F.lit(i).alias("entity_ordinal"), F.lit(entity_description(e)).alias("description"))
            for i, e in enumerate(contract.entities)
        ]
    )
    pairs = spread(texts, "source_file").select("source_file", "text", F.inline(described))
    pairs = pairs.withColumn("score", lexical_score(label(F.col("text")), label(F.col("description"))))
    if vectors is not None:
        left = vectors.select(F.col("text"), F.col("vector").alias("text_vector"))
        right = vectors.select(F.col("text").alias("description"), F.col("vector").alias("description_vector"))
        pairs = pairs.join(left, "text", "left").join(right, "description", "left")
        near = F.coalesce(cosine(F.col("text_vector"), F.col("description_vector")), F.lit(0.0))
        pairs = pairs.withColumn("score", F.greatest("score", near))
    second_tier = _top_two(pairs.withColumn("score", F.round("score", 4)))
    plausible = F.col("score") >= FALLBACK_SCORE
    if choices is None:
        choice = F.lit(None).cast("string")
    else:
        allowed = [e.name for e in contract.entities]
        choices = choices.where(F.col("entity").isin(allowed)).select("source_file", F.col("entity").alias("choice"))
        second_tier = second_tier.join(choices, "source_file", "left")
        choice = F.col("choice")
    decision = (
        F.when(plausible & (F.col("margin") >= VECTOR_MARGIN), "described")
        .when(choice.isNotNull(), "chosen")
        .when(plausible, "fallback")
        .otherwise("review")
    )
    rest = second_tier.withColumn("decision", decision).withColumn(
        "entity",
        F.when(F.col("decision") == "chosen", choice).when(F.col("decision") != "review", F.col("entity")),
    )
    shown = ["source_file", "entity", "score", "margin", "decision"]
    return settled.select(*shown).unionByName(rest.select(*shown))


def _top_two(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("source_file").orderBy(F.desc("score"), "entity_ordinal")
    return (
        scored.withColumns(
            {"rank": F.row_number().over(order), "next": F.coalesce(F.lead("score").over(order), F.lit(0.0))}
        )
        .where("rank = 1")
        .select("source_file", "entity", "score", (F.col("score") - F.col("next")).alias("margin"))
    )


# --- field matching ---------------------------------------------------------------------


def field_facts(contract: Contract) -> Column:
    """Literal array with what the score adjustment needs to know about every field."""
    rows = []
    for e in contract.entities:
        parts = _name_parts(e)
        for f in e.fields:
            words = _field_words(f)
            inside = [d for d, vocabulary in DOMAIN_WORDS.items() if words & set(vocabulary)]
            is_part = parts >= 2 and ("first_name" in f.name or "last_name" in f.name)
            aliases = [a.replace("_", " ").replace("-", " ").strip().lower() for a in f.aliases]
            rows.append(
                f"named_struct('fact_entity', {sql_text(e.name)}, 'fact_field', {sql_text(f.name)}, "
                f"'data_type', {sql_text(f.data_type)}, 'field_domains', {_sql_array(inside)}, "
                f"'is_name_part', {str(is_part).lower()}, 'exact_name', {sql_text(f.name.replace('_', ' ').lower())}, "
                f"'exact_aliases', {_sql_array(aliases)})"
            )
    return F.expr(f"array({', '.join(rows)})")


def adjusted_score(score: Column, query: Column, field_domains: Column, is_name_part: Column) -> Column:
    """Domain guards on top of text similarity, in the order of the rules."""
    words = tokens(query)
    mine = domains(words)
    strangers = (F.size(mine) > 0) & (F.size(field_domains) > 0) & ~F.arrays_overlap(mine, field_domains)
    whole_name = F.array_contains(mine, "name") & ~F.arrays_overlap(words, _text_array(NAME_PART_WORDS))

    def holds(left: str, right: str) -> Column:
        return F.array_contains(mine, left) & F.array_contains(field_domains, right)

    against = holds(*INCOMPATIBLE[0])
    for pair in INCOMPATIBLE[1:]:
        against = against | holds(*pair)
    agreed = F.arrays_overlap(F.array_intersect(mine, field_domains), _text_array(ALIGNED))
    score = score * F.when(strangers, DISJOINT_FACTOR).otherwise(1.0)
    score = score * F.when(whole_name & is_name_part, NAME_FACTOR).otherwise(1.0)
    score = score * F.when(against, INCOMPATIBLE_FACTOR).otherwise(1.0)
    score = F.when(agreed, F.least(F.lit(1.0), score + ALIGNED_BONUS)).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def match_candidates(scores: DataFrame, contract: Contract) -> DataFrame:
    """Top candidates per (label, entity): five by raw score, ranked by adjusted score."""
    raw = Window.partitionBy("query", "entity").orderBy(F.desc("raw_score"), "field_ordinal")
    top = scores.withColumn("raw_rank", F.row_number().over(raw)).where(F.col("raw_rank") <= TOP_CANDIDATES)
    fact = F.filter(
        field_facts(contract),
        lambda x: (x["fact_entity"] == F.col("entity")) & (x["fact_field"] == F.col("field")),
    )[0]
    known = top.withColumn("fact", fact).select("*", "fact.*").drop("fact", "fact_entity", "fact_field")
    adjusted = adjusted_score(F.col("raw_score"), F.col("query"), F.col("field_domains"), F.col("is_name_part"))
    reason = (
        F.when(F.col("query") == F.col("exact_name"), "exact name")
        .when(F.array_contains("exact_aliases", F.col("query")), "exact alias")
        .otherwise("similarity")
    )
    rank = Window.partitionBy("query", "entity").orderBy(F.desc("score"), "raw_rank")
    return (
        known.withColumns({"score": F.round(adjusted, 4), "raw_score": F.round("raw_score", 4), "match": reason})
        .withColumns(
            {"rank": F.row_number().over(rank), "next": F.coalesce(F.lead("score").over(rank), F.lit(0.0))}
        )
        .select(
            "query", "entity", F.col("field").alias("target_field"), "data_type", "score", "raw_score", "match", "rank",
            F.when(F.col("rank") == 1, F.col("score") - F.col("next")).alias("margin"),
        )
    )


def column_candidates(catalog: DataFrame, entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """(source_file, source_column, ordinal, inferred_type, entity, candidates): the columns of every source with what they may feed
    under the entity it holds, the best first.

    Candidates are gathered per label, of which there are few; a column stays one row.
    """
    told = ["rank", "target_field", "data_type", "score", "raw_score", "match", "margin"]
    gathered = candidates.groupBy("query", "entity").agg(F.array_sort(F.collect_list(F.struct(*told))).alias("candidates"))
    return (
        catalog.withColumn("query", exact_label(F.col("column")))
        .join(entities.where("entity is not null").select("source_file", "entity"), "source_file")
        .join(gathered, ["query", "entity"])
        .withColumnRenamed("column", "source_column")
        .drop("query")
    )


def decide_fields(column_choices: DataFrame, proposals: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """One row per column: auto, proposed, fallback, override, review or dropped.

    ``column_choices`` has one row per column with its candidates; nothing is grouped or joined back by column.
    ``proposals`` (entity, source_column, target_field, needs_review, perhaps confidence) come
    from outside and count only when they name one of the column's candidates. ``overrides`` (entity,
    source_column, target_field) are approved decisions and win with confidence 1.
    """
    keys = ["entity", "source_file", "source_column"]
    top = column_choices.select("*", F.col("candidates")[0].alias("best")).select("*", "best.*")
    fits = types_compatible(F.col("inferred_type"), F.col("data_type"))
    exact = F.col("match") != "similarity"
    auto = exact | (clear_score(F.col("score"), F.col("margin")) & fits)
    plausible = (F.col("score") >= PLAUSIBLE_SCORE) & fits
    undecided = plausible & ((F.col("margin") < UNCERTAIN_MARGIN) | (F.col("score") < AUTO_SCORE))
    stage = F.when(auto, "auto").when(undecided, "undecided").otherwise("dropped")
    decided = top.withColumn("stage", stage)
    if proposals is None:
        decided = decided.withColumns({"proposed": F.lit(None).cast("string"), "sure": F.lit(None).cast("double")})
    else:
        sure = F.col("confidence") if "confidence" in proposals.columns else F.lit(None).cast("double")
        usable = proposals.where(~F.coalesce(F.col("needs_review"), F.lit(False)))
        told = usable.groupBy("entity", "source_column").agg(F.collect_set(F.struct("target_field", sure.alias("sure"))).alias("told"))
        decided = decided.join(told, ["entity", "source_column"], "left")
        valid = F.array_min(F.filter("told", lambda t: F.array_contains(F.col("candidates.target_field"), t["target_field"])))
        decided = decided.withColumns({"proposed": valid["target_field"], "sure": valid["sure"]})
    if overrides is None:
        decided = decided.withColumn("override", F.lit(None).cast("string"))
    else:
        approved = overrides.select("entity", "source_column", F.col("target_field").alias("override"))
        decided = decided.join(approved, ["entity", "source_column"], "left")
    decision = (
        F.when(F.col("override").isNotNull(), "override")
        .when(F.col("stage") == "auto", "auto")
        .when((F.col("stage") == "undecided") & F.col("proposed").isNotNull(), "proposed")
        .when((F.col("stage") == "undecided") & plausible, "fallback")
        .when(F.col("stage") == "undecided", "review")
        .otherwise("dropped")
    )
    decided = decided.withColumn("decision", decision)
    target = (
        F.when(F.col("decision") == "override", F.col("override"))
        .when(F.col("decision") == "proposed", F.col("proposed"))
        .when(F.col("decision").isin("auto", "fallback"), F.col("target_field"))
    )
    return decided.select(
        *keys,
        "ordinal",
        "inferred_type",
        target.alias("target_field"),
        F.col("target_field").alias("best_field"),
        F.when(F.col("decision") == "override", 1.0)
        .when(F.col("decision") == "proposed", F.coalesce("sure", "score"))
        .otherwise(F.col("score"))
        .alias("confidence"),
        "raw_score",
        F.round("margin", 4).alias("margin"),
        "match",
        "decision",
        F.transform(F.slice("candidates", 2, 2), lambda x: F.struct(x["target_field"].alias("field"), x["score"].alias("score"))).alias("alternatives"),
    )


# --- coverage ---------------------------------------------------------------------------


def missing_required(mapped: DataFrame, fields: DataFrame, catalog: DataFrame, entities: DataFrame) -> DataFrame:
    """Required fields of the entities in use that no column feeds, with the columns on offer."""
    used = entities.where("entity is not null").select("source_file", "entity")
    covered = mapped.where("target_field is not null").select("entity", F.col("target_field").alias("field"))
    offered = available_columns(catalog, entities)
    return (
        fields.where("required")
        .join(used.select("entity").distinct(), "entity", "left_semi")
        .join(covered, ["entity", "field"], "left_anti")
        .join(offered, "entity", "left")
        .select("entity", F.col("field").alias("target_field"), "available_source_fields")
    )


def available_columns(catalog: DataFrame, entities: DataFrame) -> DataFrame:
    """Sorted union of the columns of an entity's sources; headers repeat, so sets stay small."""
    return (
        catalog.join(entities.where("entity is not null").select("source_file", "entity"), "source_file")
        .select("entity", "column")
        .distinct()
        .groupBy("entity")
        .agg(F.array_sort(F.collect_list("column")).alias("available_source_fields"))
    )


def split_mapping_reviews(reviews: DataFrame, missing: DataFrame) -> DataFrame:
    """Keep a mapping review only if it touches a missing required field or has no candidates.

    ``reviews`` has entity, source_column, candidates ARRAY<STRING>, target_field. The rest is
    flagged ``suppressed`` for the audit.
    """
    gaps = missing.groupBy("entity").agg(F.collect_set("target_field").alias("gaps"))
    named = F.array_compact(F.concat(F.coalesce("candidates", F.array().cast("array<string>")), F.array("target_field")))
    keep = F.arrays_overlap(named, F.coalesce("gaps", F.array().cast("array<string>"))) | (
        F.coalesce(F.size("candidates"), F.lit(0)) <= 0
    )
    return reviews.join(gaps, "entity", "left").withColumn("suppressed", ~keep).drop("gaps")
