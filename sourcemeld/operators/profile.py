"""File and column profiles."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcemeld.functions import kernels
from sourcemeld.functions.text import BLANKS, filled, sql_text
from sourcemeld.sources.readers import data_columns

# Executors need no copy of this package for the kernels.
cloudpickle.register_pickle_by_value(kernels)

SAMPLES = 5

# Shapes that tell the type of a text.
INTEGER = r"^[+-]?(0|[1-9][0-9]*)$"
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
DATE = r"^([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}|[A-Za-z]{3,9} [0-9]{1,2},? [0-9]{4}|[0-9]{1,2} [A-Za-z]{3,9} [0-9]{4})"
CLOCK = r"[T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"


def _stripped(raw: str) -> str:
    return f"trim(both {sql_text(BLANKS)} from {raw})"


def value_type(name: str) -> Column:
    """Narrowest contract type one text of a column fits; NULL for a missing value.

    Numbers, dates and times end in a digit, a point or Z; other texts meet no pattern.
    """
    raw = f"`{name}`"
    t = _stripped(raw)
    return F.expr(
        f"case when {raw} is null or {raw} = '' then null "
        f"when lower({t}) in ('true', 'false') then 'boolean' "
        f"when right({t}, 1) not in ('0', '1', '2', '3', '4', '5', '6', '7', '8', '9', '.', 'Z') then 'string' "
        f"when {t} rlike '{INTEGER}' then 'integer' "
        f"when {t} rlike '{NUMBER}' and not {t} rlike '^[+-]?0[0-9]+$' then 'number' "
        f"when {t} rlike '{DATE}$' then 'date' "
        f"when {t} rlike '{DATE}{CLOCK}' then 'datetime' else 'string' end"
    )


def file_manifest(df: DataFrame) -> DataFrame:
    """Rows per source file; the files of one entity need not be listed beforehand."""
    return df.groupBy("source_file").agg(F.count(F.lit(1)).alias("row_count"))


def value_facts(name: str) -> dict[str, str]:
    """What the texts of a column show beside their type, as conditions on one of them.

    ``noisy_number``: digits among other signs than one point and one minus; the others: a separator of lists.
    """
    raw = f"`{name}`"
    t = _stripped(raw)

    def at_most_one(sign: str) -> str:
        return f"length(replace({t}, '{sign}', '')) >= length({t}) - 1"

    plain = f"({t} rlike '^[0-9.-]*[0-9][0-9.-]*$' and {at_most_one('.')} and {at_most_one('-')})"
    return {
        "noisy_number": f"{raw} <> '' and {raw} rlike '[0-9]' and not {plain}",
        "has_semicolon": f"contains({raw}, ';')",
        "has_comma": f"contains({raw}, ',')",
        "has_pipe": f"contains({raw}, '|')",
    }


FACTS = ("noisy_number", "has_semicolon", "has_comma", "has_pipe")


def source_profile(df: DataFrame) -> DataFrame:
    """(source_file, column, ordinal, inferred_type, n_rows, n_nulls and the ``FACTS``) in one pass over all rows.

    Counts per type are summed map-side, so what is shuffled follows files and columns, not rows. The plan is the same for three columns
    and for three hundred.
    """
    cells = F.array(
        *[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("column"), F.col(f"`{n}`").cast("string").alias("value")) for i, n in enumerate(data_columns(df))]
    )
    shown = value_facts("value")
    kinds = df.select("source_file", F.inline(cells)).withColumn("kind", value_type("value"))
    types = ("integer", "number", "boolean", "date", "datetime")
    counted = kinds.groupBy("source_file", "column", "ordinal").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("kind").alias("filled"),
        *[F.expr(f"count_if(kind = '{t}')").alias(f"n_{t}") for t in types],
        *[F.expr(f"coalesce(bool_or({shown[fact]}), false)").alias(fact) for fact in FACTS],
    )
    inferred = F.expr(
        "case when filled = 0 then 'unknown' when n_integer = filled then 'integer' when n_integer + n_number = filled then 'number' "
        "when n_boolean = filled then 'boolean' when n_date = filled then 'date' when n_date + n_datetime = filled then 'datetime' else 'string' end"
    )
    return counted.select(
        "source_file", "column", "ordinal", inferred.alias("inferred_type"), "n_rows", (F.col("n_rows") - F.col("filled")).alias("n_nulls"), *FACTS
    )


def column_types(df: DataFrame) -> DataFrame:
    """(source_file, column, ordinal, inferred_type, n_rows, n_nulls) in one pass over all rows."""
    return source_profile(df).drop(*FACTS)


def column_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Tidy form (source_file, source_row_number, column, value)."""
    names = columns or data_columns(df)
    cells = F.array(
        *[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("string").alias("value")) for n in names]
    )
    return df.select("source_file", "source_row_number", F.inline(cells))


def column_samples(df: DataFrame) -> DataFrame:
    """First five non-null values of each column over all rows of a file.

    Of every batch of rows only the first five values of each column and file go on, so no task sorts or holds its rows.
    """
    names = data_columns(df)
    cells = df.select("source_file", "source_row_number", *[F.col(f"`{n}`").cast("string").alias(f"c{i}") for i, n in enumerate(names)])
    early = cells.mapInArrow(kernels.first_filled(names, SAMPLES), "source_file string, source_row_number bigint, column string, value string")
    order = Window.partitionBy("source_file", "column").orderBy("source_row_number")
    return (
        early.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= SAMPLES)
        .groupBy("source_file", "column")
        .agg(F.array_sort(F.collect_list(F.struct("source_row_number", "value"))).alias("first"))
        .select("source_file", "column", F.col("first.value").alias("samples"))
    )


def profile(df: DataFrame) -> DataFrame:
    """File profile: types and counts over all rows, the first samples of each file."""
    return column_types(df).join(column_samples(df), ["source_file", "column"], "left")


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n_rows) over all rows, blanks left out; counts are combined map-side."""
    return column_values(df, columns).where(filled(F.col("value"))).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
