"""Text similarity on labels and values, meant for distinct pairs."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcemeld.functions import kernels

# Executors need no copy of this package for the kernels.
cloudpickle.register_pickle_by_value(kernels)

_ratio = F.pandas_udf(kernels.ratio_series, T.DoubleType())


def ratio(a: Column, b: Column) -> Column:
    """2 * LCS / (len a + len b), computed in Arrow batches."""
    return _ratio(a, b)


def native_ratio(a: Column, b: Column) -> Column:
    """The same measure without Python, for short texts where a stage should stay in the JVM."""
    letters = F.split(b, "")
    start = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def row(best: Column, ch: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            diagonal = F.element_at(best, j) + (F.element_at(letters, j) == ch).cast("int")
            return F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), F.element_at(best, j + 1), diagonal)))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    lcs = F.element_at(F.aggregate(F.split(a, ""), start, row), -1)
    empty = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(a == b, 1.0).when(empty, 0.0).otherwise(2.0 * lcs / (F.length(a) + F.length(b)))


def words(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(c, " "), lambda w: w != "")))


def token_set_ratio(
    a: Column, b: Column, measure=ratio, whole: Column | None = None, split: tuple[Column, Column] | None = None
) -> Column:
    """Compare shared words, shared + own words of each side; 1 when a side has no word of its own.

    ``whole`` is the measure of ``a`` and ``b`` if it is known; texts whose words stand in order already are not measured twice.
    ``split`` has the ``words`` of both sides where they are columns already.
    """
    wa, wb = split or (words(a), words(b))
    shared = F.array_intersect(wa, wb)
    own_a, own_b = F.array_except(wa, wb), F.array_except(wb, wa)
    s = F.array_join(shared, " ")
    sa = F.array_join(F.concat(shared, own_a), " ")
    sb = F.array_join(F.concat(shared, own_b), " ")
    if whole is None:
        full = measure(sa, sb)
    else:
        moved = (sa != a) | (sb != b)
        full = F.coalesce(measure(F.when(moved, sa), F.when(moved, sb)), whole)

    def prefix(longer: Column) -> Column:
        return 2.0 * F.length(s) / (F.length(s) + F.length(longer))

    return (
        F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0)
        .when((F.size(shared) > 0) & ((F.size(own_a) == 0) | (F.size(own_b) == 0)), 1.0)
        .when(F.size(shared) > 0, F.greatest(full, prefix(sa), prefix(sb)))
        .otherwise(full)
    )


def lexical_score(a: Column, b: Column, measure=ratio, split: tuple[Column, Column] | None = None) -> Column:
    """Score of two normalised labels; ``split`` has their ``words`` where they are columns already."""
    whole = measure(a, b)
    return F.greatest(whole, token_set_ratio(a, b, measure, whole, split))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of equal length; a zero vector scores 0."""

    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)

    def product(x: Column, y: Column) -> Column:
        return F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q)

    norm = F.sqrt(total(product(a, a))) * F.sqrt(total(product(b, b)))
    return F.when(norm == 0, 0.0).otherwise(total(product(a, b)) / norm)
