"""What a value or a written table costs: no more work per row than its meaning needs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcemeld.functions import kernels
from sourcemeld.functions.standard import PLAIN_DATE, Value, standardise
from sourcemeld.functions.text import strip
from sourcemeld.functions.similarity import lexical_score, ratio, token_set_ratio
from sourcemeld.operators import profile
from sourcemeld.operators.planning import enum_plan, enum_plans
from sourcemeld.session import METHOD_LIMIT, Scratch


def _plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_blanks_are_stripped_without_a_pattern(spark):
    odd = "  \t\x85 a 　b​ \n"
    df = spark.createDataFrame([(odd,), ("",), (None,), ("   ",)], "v string")
    shown = df.select(strip(F.col("v")).alias("v"))
    assert [r.v for r in shown.collect()] == ["a 　b​", "", None, ""]
    assert "regexp" not in _plan(shown)


def test_frequent_dates_are_not_rewritten(spark):
    """Dates of plain shape come out as the rewriting has them, before any of its patterns."""
    told = {
        "2024-5-03": "2024-05-03", " 03/05/2024 ": "2024-05-03", "13.05.2024": "2024-05-13", "05-13-2024": "2024-05-13",
        "2024/13/01": None, "May 5, 2024": "2024-05-05", "anf 5, 2024": None, "mar 31 2024": "2024-03-31", "1/2-2024": None,
        "5th May 2024": "2024-05-05", "20240503": "2024-05-03", "01-02-69": "1969-02-01", "30.02.2024": None,
    }
    df = spark.createDataFrame([(k, v) for k, v in told.items()], "v string, wanted string")
    shown = df.select("v", "wanted", standardise(Value(F.col("v")), "parse_date_auto").col.alias("date"))
    assert {r.v: r.date for r in shown.collect()} == told
    plan = _plan(shown)
    assert plan.index(PLAIN_DATE) < plan.index("regexp_replace")


def test_tables_are_written_by_methods_that_the_jvm_compiles(spark):
    seen = []

    class Frame:
        schema = "id bigint"

        @property
        def write(self):
            return self

        def parquet(self, path):
            seen.append(int(spark.conf.get(METHOD_LIMIT)))
            spark.range(3).write.parquet(path)

    before = spark.conf.get(METHOD_LIMIT)
    assert Scratch(spark).write(Frame(), "some").count() == 3
    assert seen[0] <= 8000 and spark.conf.get(METHOD_LIMIT) == before


def test_first_samples_are_taken_without_sorting_all_rows(spark):
    """Rows out of order, several files, nulls; what reaches the window is five values per batch, column and file."""
    rows = [(f"f{k % 2}", k, None if k % 3 == 0 else f"v{k}", None) for k in range(4000, 0, -1)]
    df = spark.createDataFrame(rows, "source_file string, source_row_number bigint, `a b` string, empty string").coalesce(1)
    got = {(r.source_file, r.column): r.samples for r in profile.column_samples(df).collect()}
    assert got == {(f, "a b"): [f"v{k}" for k in range(1, 40) if k % 3 and k % 2 == i][:5] for i, f in enumerate(("f0", "f1"))}
    names = ["a b", "empty"]
    early = df.mapInArrow(kernels.first_filled(names, 5), "source_file string, source_row_number bigint, column string, value string")
    assert early.count() == 10


def test_enumerated_values_are_read_once_and_told_apart_as_distinct_values(spark, tmp_path):
    values = [" High ", "high", "currently x", "left_1", "hgih", "Hight prio", "prio  high", "zz1", "", None, "low"]
    spark.createDataFrame([(v,) for v in values * 3], "value string").write.parquet(str(tmp_path / "v"))
    given = spark.read.parquet(str(tmp_path / "v"))
    plan = enum_plan(given, ["HIGH", "LOW", "ACTIVE", "INACTIVE"], {"low": "LOW"})
    got = {r.value: (r.target, r.tier, r.score) for r in plan.collect()}
    assert got == {
        "High": ("HIGH", "equal", None), "high": ("HIGH", "equal", None), "currently x": ("ACTIVE", "word", None), "left_1": ("INACTIVE", "word", None),
        "hgih": ("HIGH", "lexical", 0.75), "Hight prio": (None, "unresolved", 0.5714), "prio  high": ("HIGH", "lexical", 1.0), "zz1": (None, "unresolved", 0.0),
        "low": ("LOW", "existing", None),
    }
    shown = plan._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("parquet") == 1
    owned = enum_plans(given.selectExpr("1 as owner", "value").union(given.selectExpr("2 as owner", "value")), {1: ["HIGH"], 2: ["LOW", "HIGHT"]})
    assert {(r.owner, r.target, r.tier) for r in owned.where("value = 'hgih'").collect()} == {(1, "HIGH", "lexical"), (2, "HIGHT", "lexical")}


def test_texts_in_word_order_are_measured_once(spark):
    pairs = [("a b", "a c"), ("b a", "a b c"), ("zz1", "urgent"), ("x x", "x"), ("", "a"), ("order date", "date of order")]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    seen = df.select(lexical_score(a, b).alias("s"), F.greatest(ratio(a, b), token_set_ratio(a, b)).alias("t")).collect()
    assert all(r.s == r.t for r in seen)
