"""Which steps a mapped column needs, decided over all of its values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemeld.contract import Field
from sourcemeld.functions.similarity import lexical_score, words
from sourcemeld.functions.steps import Step
from sourcemeld.functions.text import filled, label, strip
from sourcemeld.operators.profile import column_values
from sourcemeld.operators.skew import spread
from sourcemeld.settings import FALLBACK_SCORE

# Words that speak for an ACTIVE or INACTIVE target value.
ACTIVE_WORDS = ("active", "working", "employed", "current", "currently")
INACTIVE_WORDS = ("inactive", "left", "terminated", "former", "exited", "resigned", "retired")


@dataclass(frozen=True)
class Need:
    """What a kind of target asks of its values: one of ``met_by``, and the step that is added where none is there.

    A need with a ``fact`` holds only for columns whose values show it; a need that is ``certain`` shows from
    the contract alone, so it is proposed before any value is read.
    """

    met_by: frozenset[str]
    add: str
    fact: str | None = None
    certain: bool = False


_NUMERIC = frozenset(("normalize_integer", "normalize_decimal", "extract_number"))
NEEDS = {
    "integer": Need(_NUMERIC, "normalize_integer", fact="noisy_number"),
    "number": Need(_NUMERIC, "normalize_decimal", fact="noisy_number"),
    "boolean": Need(frozenset(("normalize_boolean", "map_value")), "normalize_boolean"),
    "date": Need(frozenset(("parse_date", "parse_date_auto")), "parse_date_auto", certain=True),
    "datetime": Need(frozenset(("parse_date", "parse_date_auto", "parse_datetime_auto")), "parse_datetime_auto", certain=True),
    "email": Need(frozenset(("normalize_email",)), "normalize_email", certain=True),
    "phone": Need(frozenset(("normalize_phone",)), "normalize_phone", certain=True),
    "array": Need(frozenset(("split",)), "split", fact="separator"),
}
#: Separators in the order in which they are trusted, and the fact that a column holds them.
SEPARATORS = {"has_semicolon": ";", "has_comma": ",", "has_pipe": "|"}


def need_of(field: Field) -> Need | None:
    """The need of a field: by its type, or for texts by the kind of address its name speaks of."""
    if field.data_type != "string":
        return NEEDS.get(field.data_type)
    return next((NEEDS[kind] for kind in ("email", "phone") if kind in field.name), None)


def default_steps(field: Field) -> list[Step]:
    """First proposal for a mapped field, from the contract alone."""
    if field.enum_values:
        return [Step("map_value", {"mapping": {}})]
    need = need_of(field)
    return [Step(need.add if need and need.certain else "trim")]


def plain_number(c: Column) -> Column:
    """Digits with at most one point and one minus sign."""
    t = strip(c)

    def at_most_one(ch: str) -> Column:
        return F.length(F.replace(t, F.lit(ch), F.lit(""))) >= F.length(t) - 1

    return t.rlike(r"^[0-9.\-]*[0-9][0-9.\-]*$") & at_most_one(".") & at_most_one("-")


def column_facts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, noisy_number, has_semicolon, has_comma, has_pipe) in one pass over all values."""
    values = column_values(df, columns)
    v = F.col("value")
    noisy = filled(v) & v.rlike("[0-9]") & ~plain_number(v)
    return values.groupBy("column").agg(
        F.coalesce(F.bool_or(noisy), F.lit(False)).alias("noisy_number"),
        *[
            F.coalesce(F.bool_or(F.contains(v, F.lit(ch))), F.lit(False)).alias(name)
            for name, ch in (("has_semicolon", ";"), ("has_comma", ","), ("has_pipe", "|"))
        ],
    )


def plan_steps(field: Field, facts: dict, proposed: list[Step]) -> list[Step]:
    """The proposed steps, after the one that the field needs and none of them brings."""
    need = need_of(field)
    shown = dict(facts)
    separator = next((sign for fact, sign in SEPARATORS.items() if facts.get(fact)), None)
    shown["separator"] = separator
    open_need = need and need.met_by.isdisjoint(s.operation for s in proposed) and (need.fact is None or shown.get(need.fact))
    if open_need:
        return [Step(need.add, {"separator": separator} if need.fact == "separator" else {}), *proposed]
    return list(proposed) or [Step("trim")]


def enum_tiers(value: Column, allowed: list[str], existing: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(target, tier) by known mapping, equality without case and status words; no similarity."""
    key = strip(value)
    known = {k: v for k, v in (existing or {}).items() if v in allowed}
    mapped = F.lit(None).cast("string")
    if known:
        mapped = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), key)
    equal = F.coalesce(*[F.when(F.lower(F.lit(a)) == F.lower(key), F.lit(a)) for a in allowed])
    words = F.split(label(key), " ")
    by_word = F.lit(None).cast("string")
    for target, vocabulary in (("inactive", INACTIVE_WORDS), ("active", ACTIVE_WORDS)):
        spelled = next((a for a in reversed(allowed) if a.lower() == target), None)
        if spelled:
            hit = F.arrays_overlap(words, F.array(*[F.lit(w) for w in vocabulary]))
            by_word = F.when(hit, F.lit(spelled)).otherwise(by_word)
    tier = F.when(mapped.isNotNull(), "existing").when(equal.isNotNull(), "equal").when(by_word.isNotNull(), "word")
    return F.coalesce(mapped, equal, by_word), tier


def _settled(keys: DataFrame, by: list[str], cheap: tuple[Column, Column], options: Column, answers: DataFrame | None) -> DataFrame:
    """``keys`` (the columns ``by``, value among them) with target, tier and score.

    Only values that no cheap tier settles are scored, beside the others, so the values are read and told apart once. ``answers`` (``by`` and target) come from outside and are usable ones.
    """
    found = spread(keys, "value").withColumns({"target": cheap[0], "tier": cheap[1], "a": label(F.col("value"))})
    is_open = F.col("tier").isNull()
    scored = (
        found.select(*by, "target", "tier", F.when(is_open, F.col("a")).alias("a"), F.when(is_open, words(F.col("a"))).alias("aw"), options.alias("options"))
        .select(*by, "target", "tier", "a", "aw", F.inline_outer(F.when(is_open, F.col("options"))))
        .where("tier is not null or option is not null")
        .withColumn("s", lexical_score(F.col("a"), F.col("b"), split=(F.col("aw"), F.col("bw"))))
        .groupBy(*by, "target", "tier")
        .agg(F.max_by("option", F.struct("s", -F.col("place"))).alias("option"), F.max("s").alias("score"))
    )
    answer = F.lit(None).cast("string")
    if answers is not None:
        scored = scored.join(answers.groupBy(*by).agg(F.max("target").alias("answer")), by, "left")
        answer = F.col("answer")
    near = F.col("score") >= FALLBACK_SCORE
    return scored.select(
        *by,
        F.coalesce("target", F.when(near, F.col("option")).otherwise(answer)).alias("target"),
        F.coalesce("tier", F.when(near, "lexical").when(answer.isNotNull(), "answered").otherwise("unresolved")).alias("tier"),
        F.round("score", 4).alias("score"),
    )


def _options(allowed: list[str]) -> Column:
    """The allowed values in order, with what is compared of them: label and words."""
    return F.array(
        *[
            F.struct(F.lit(a).alias("option"), F.lit(i).alias("place"), label(F.lit(a)).alias("b"), words(label(F.lit(a))).alias("bw"))
            for i, a in enumerate(allowed)
        ]
    )


def enum_plan(
    values: DataFrame, allowed: list[str], existing: dict[str, str] | None = None, answers: DataFrame | None = None
) -> DataFrame:
    """(value, target, tier, score) for distinct values; tier ``unresolved`` has no target.

    ``answers`` (value, target) come from outside and count only when the target is an allowed value.
    """
    keys = values.select(strip(F.col("value")).alias("value")).where(filled(F.col("value"))).distinct()
    usable = None if answers is None else answers.where(F.col("target").isin(allowed))
    return _settled(keys, ["value"], enum_tiers(F.col("value"), allowed, existing), _options(allowed), usable)


def enum_plans(values: DataFrame, allowed: dict[int, list[str]], answers: DataFrame | None = None) -> DataFrame:
    """(owner, value, target, tier, score) for the distinct values of many columns at once.

    An owner is a mapped column, given by a number; ``allowed`` has the values of its field. ``answers`` are (owner, value, target).
    """
    keys = values.select("owner", strip(F.col("value")).alias("value")).where(filled(F.col("value"))).distinct()
    lists: dict[tuple[str, ...], list[int]] = {}
    for owner, choices in allowed.items():
        lists.setdefault(tuple(choices), []).append(owner)
    target = tier = F.lit(None).cast("string")
    options, right = F.lit(None).cast("array<struct<option:string,place:int,b:string,bw:array<string>>>"), F.lit(False)
    for choices, owners in lists.items():
        mine = F.col("owner").isin(owners)
        to, how = enum_tiers(F.col("value"), list(choices))
        target, tier = F.when(mine, to).otherwise(target), F.when(mine, how).otherwise(tier)
        options = F.when(mine, _options(list(choices))).otherwise(options)
        right = right | (mine & F.col("target").isin(list(choices)))
    usable = None if answers is None else answers.where(right)
    return _settled(keys, ["owner", "value"], (target, tier), options, usable)


def unresolved_reviews(plan: DataFrame, owners: dict[int, tuple[str, str, str, str]]) -> DataFrame:
    """One row per unresolved value of a column; ``owners``: entity, file, source and target field of each."""
    names = ("entity", "source_file", "source_field", "target_field")
    told = F.lit(None).cast("struct<entity:string,source_file:string,source_field:string,target_field:string>")
    for owner, of in owners.items():
        told = F.when(F.col("owner") == owner, F.struct(*[F.lit(v).alias(n) for n, v in zip(names, of)])).otherwise(told)
    return plan.where("tier = 'unresolved'").select(told.alias("of"), "value").select("of.*", F.col("value").alias("unresolved_value"))
