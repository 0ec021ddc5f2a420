"""Run ordered steps over many columns in one pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemeld.functions.standard import REGISTRY, TEXT, StepError, Value, as_text, standardise
from sourcemeld.functions.text import is_missing


@dataclass(frozen=True)
class Step:
    operation: str
    params: dict = field(default_factory=dict)
    proposed: str | None = None


@dataclass(frozen=True)
class Chain:
    """Steps for one column; results land in ``<name>__value``, ``__error`` and ``__applied``."""

    name: str
    source: Column
    steps: tuple[Step, ...]


def run_chains(df: DataFrame, chains: list[Chain], skip_missing: bool = False) -> DataFrame:
    """Steps run in order and stop at the first error.

    Step n of every column is one projection, so the expression trees stay small and all
    projections share one stage. ``<name>__value`` is the canonical text of the result, or
    of the value reached when a step failed. With ``skip_missing`` a missing input is a
    missing output, not an error.
    """
    kinds = {c.name: TEXT for c in chains}
    state = df.withColumns({f"{c.name}__v": c.source.cast("string") for c in chains})
    for depth in range(max((len(c.steps) for c in chains), default=0)):
        tried, settled = {}, {}
        for c in (c for c in chains if depth < len(c.steps)):
            n = c.name
            value = Value(F.col(f"{n}__v"), kinds[n])
            new, error, kind = _attempt(c.steps[depth], value)
            if skip_missing and error is not None:
                error = F.when(~is_missing(c.source.cast("string")), error)
            tried[f"{n}__new"] = new
            tried[f"{n}__err"] = F.lit(None).cast("string") if error is None else error
            err = F.col(f"{n}__err")
            if depth == 0:
                settled[f"{n}__error"] = err
                settled[f"{n}__t"] = F.when(err.isNotNull(), as_text(value))
                settled[f"{n}__n"] = F.when(err.isNull(), 1).otherwise(0)
                settled[f"{n}__v"] = F.when(err.isNull(), F.col(f"{n}__new"))
            else:
                before = F.col(f"{n}__error")
                fine = before.isNull() & err.isNull()
                settled[f"{n}__error"] = F.coalesce(before, err)
                settled[f"{n}__t"] = F.when(before.isNull() & err.isNotNull(), as_text(value)).otherwise(F.col(f"{n}__t"))
                settled[f"{n}__n"] = F.col(f"{n}__n") + fine.cast("int")
                settled[f"{n}__v"] = F.when(fine, F.col(f"{n}__new"))
            kinds[n] = kind
        state = state.withColumns(tried).withColumns(settled)
    final = {}
    for c in chains:
        n = c.name
        result = as_text(Value(F.col(f"{n}__v"), kinds[n]))
        if c.steps:
            names = F.array(*[F.lit(s.operation) for s in c.steps])
            final[f"{n}__value"] = F.coalesce(F.col(f"{n}__t"), result)
            final[f"{n}__applied"] = F.slice(names, F.lit(1), F.col(f"{n}__n"))
        else:
            final[f"{n}__value"] = result
            final[f"{n}__error"] = F.lit(None).cast("string")
            final[f"{n}__applied"] = F.array().cast("array<string>")
        if skip_missing:
            final[f"{n}__value"] = F.when(~is_missing(c.source.cast("string")), final[f"{n}__value"])
    helpers = [f"{c.name}__{part}" for c in chains for part in ("v", "t", "n", "new", "err")]
    return state.withColumns(final).drop(*helpers)


def _attempt(step: Step, value: Value) -> tuple[Column, Column | None, str]:
    if step.proposed:
        return value.col, F.lit("new_transformation"), value.kind
    if step.operation not in REGISTRY:
        return value.col, F.lit("unsupported_operation"), value.kind
    try:
        outcome = standardise(value, step.operation, step.params)
    except StepError as exc:
        return value.col, F.lit(str(exc)), value.kind
    return outcome.col, outcome.error, outcome.kind


def error_reason(error: Column) -> Column:
    """Review reason of a step error."""
    known = ("new_transformation", "unsupported_operation", "unmapped_value")
    return F.when(error.isin(*known), error).when(error.isNotNull(), F.lit("invalid_record"))
