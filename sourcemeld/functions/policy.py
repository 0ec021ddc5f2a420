"""Decision expressions shared by matching, planning and merging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourcemeld.functions.text import conflict_key, is_missing
from sourcemeld.settings import AUTO_MARGIN, AUTO_SCORE, FALLBACK_SCORE


def clear_score(score: Column, margin: Column) -> Column:
    return (score >= AUTO_SCORE) & (margin >= AUTO_MARGIN)


def mapping_decision(score: Column, margin: Column) -> Column:
    return F.when(clear_score(score, margin) | (score >= FALLBACK_SCORE), "auto").otherwise("escalate")


def step_decision(known_operation: Column, has_safe_fallback: Column) -> Column:
    return F.when(known_operation | has_safe_fallback, "auto").otherwise("escalate")


def value_decision(left: Column, right: Column) -> Column:
    same = is_missing(left) | is_missing(right) | (conflict_key(left) == conflict_key(right))
    return F.when(same, "auto").otherwise("escalate")


def types_compatible(source: Column, target: Column) -> Column:
    numeric = ("integer", "number")
    return (
        source.isin("unknown", "string")
        | (source == target)
        | (source.isin(*numeric) & target.isin(*numeric))
        | ((source == "date") & target.isin("date", "datetime"))
    )
