import pytest
from pyspark.sql import functions as F

from sourcemeld.functions.standard import REGISTRY, Outcome, StepError, Value, date_pattern, standardise, standardiser
from sourcemeld.functions.steps import Chain, Step, error_reason, run_chains

CASES = [
    ("trim", "\t  a b \n", {}, "a b", False),
    ("collapse_whitespace", "  Jane   Doe  ", {}, "Jane Doe", False),
    ("lowercase", "ABC", {}, "abc", False),
    ("uppercase", "abc", {}, "ABC", False),
    ("normalize_name", "  Mc  Donald ", {}, "Mc Donald", False),
    ("normalize_email", " JOHN@ABC.COM ", {}, "john@abc.com", False),
    ("normalize_phone", "+91 (98765) 43210", {}, "919876543210", False),
    ("normalize_phone", "none", {}, "", False),
    ("normalize_phone", None, {}, None, False),
    ("parse_date", "15/07/2024", {"input_format": "%d/%m/%Y"}, "2024-07-15", False),
    ("parse_date", "15/07/2024", {"format": "%d/%m/%Y"}, "2024-07-15", False),
    ("parse_date", "15/07/2024", {"date_format": "%d/%m/%Y", "outputFormat": "%b %d, %Y"}, "Jul 15, 2024", False),
    ("parse_date", "5/7/68", {"inputFormat": "%d/%m/%y"}, "2068-07-05", False),
    ("parse_date", "5/7/70", {"inputFormat": "%d/%m/%y"}, "1970-07-05", False),
    ("parse_date", "31/02/2024", {"format": "%d/%m/%Y"}, "31/02/2024", True),
    ("parse_date", "", {"format": "%d/%m/%Y"}, None, False),
    ("parse_date_auto", "Aug 01, 2022", {}, "2022-08-01", False),
    ("parse_date_auto", "1 Sept 2022", {}, "2022-09-01", False),
    ("parse_date_auto", "01/08/2022", {}, "2022-08-01", False),
    ("parse_date_auto", "07/25/2020", {}, "2020-07-25", False),
    ("parse_date_auto", "2022-01-08", {}, "2022-01-08", False),
    ("parse_date_auto", "2022-01-08 00:00:00", {}, "2022-01-08", False),
    ("parse_date_auto", "2022/1/8", {}, "2022-01-08", False),
    ("parse_date_auto", "2022", {}, "2022", True),
    ("parse_date_auto", "soon", {}, "soon", True),
    ("parse_datetime_auto", "2024-01-01T10:11:12.5Z", {}, "2024-01-01T10:11:12", False),
    ("parse_datetime_auto", "03/04/2021 5:06 PM", {}, "2021-03-04T17:06:00", False),
    ("parse_datetime_auto", "12 Mar 2021 12:06 am", {}, "2021-03-12T00:06:00", False),
    ("parse_datetime_auto", "nope", {}, "nope", True),
    ("extract_number", "₹1,25,000", {}, "125000", False),
    ("extract_number", "-3.50 kg", {}, "-3.5", False),
    ("extract_number", "x", {}, "x", True),
    ("extract_number", None, {}, None, False),
    ("normalize_integer", "₹1,25,000", {}, "125000", False),
    ("normalize_integer", "-12.9", {}, "-12", False),
    ("normalize_integer", "9007199254740993", {}, "9007199254740993", False),
    ("normalize_decimal", "12.3456 USD", {"decimals": 2}, "12.35", False),
    ("normalize_decimal", "12.3456 USD", {"precision": 1}, "12.3", False),
    ("normalize_decimal", "2.675", {}, "2.68", False),
    ("map_value", " ACTIVE ", {"mapping": {"Active": "A"}}, "A", False),
    ("map_value", "x", {"mapping": {"Active": "A"}}, "x", True),
    ("map_value", None, {"mapping": {"Active": "A"}}, None, True),
    ("map_value", "x", {"mapping": {}}, "x", True),
    ("split", "Engineering, Finance; HR", {"separator": ","}, '["Engineering","Finance; HR"]', False),
    ("split", "a|b||", {"separator": "|"}, '["a","b"]', False),
    ("split", None, {}, "[]", False),
    ("normalize_boolean", "Working", {}, "true", False),
    ("normalize_boolean", " LEFT ", {}, "false", False),
    ("normalize_boolean", "ja", {"true_values": ["Ja"], "false_values": ["nein"]}, "true", False),
    ("normalize_boolean", None, {}, None, True),
]


def test_values_and_errors(spark):
    rows = spark.createDataFrame([tuple(c[1] for c in CASES)], ", ".join(f"x{i} string" for i in range(len(CASES))))
    chains = [Chain(f"c{i}", F.col(f"x{i}"), (Step(op, params),)) for i, (op, _, params, _, _) in enumerate(CASES)]
    for start in range(0, len(chains), 10):
        row = run_chains(rows, chains[start : start + 10]).first()
        for i in range(start, min(start + 10, len(chains))):
            op, value, params, expected, fails = CASES[i]
            got = (row[f"c{i}__value"], row[f"c{i}__error"] is not None)
            assert got == (expected, fails), (op, value, params, got)


def test_chain_stops_at_the_first_error(spark):
    df = spark.createDataFrame([(" 7 kg ",), (" none ",), (None,)], "x string")
    steps = (Step("trim"), Step("extract_number"), Step("uppercase"))
    rows = run_chains(df, [Chain("c", F.col("x"), steps)]).orderBy("x").collect()
    by_input = {r.x: r for r in rows}
    assert by_input[" 7 kg "].c__value == "7" and by_input[" 7 kg "].c__applied == ["trim", "extract_number", "uppercase"]
    assert by_input[" none "].c__value == "none" and by_input[" none "].c__applied == ["trim"]
    assert by_input[" none "].c__error.startswith("No number found")


def test_split_then_join(spark):
    df = spark.createDataFrame([("a; b;;",), (None,)], "x string")
    steps = (Step("split", {"separator": ";"}), Step("join", {"separator": " | "}))
    values = {r.x: r.c__value for r in run_chains(df, [Chain("c", F.col("x"), steps)]).collect()}
    assert values == {"a; b;;": "a | b", None: ""}
    skipped = {r.x: r.c__value for r in run_chains(df, [Chain("c", F.col("x"), steps)], skip_missing=True).collect()}
    assert skipped == {"a; b;;": "a | b", None: None}


def test_unknown_proposed_and_bad_parameters(spark):
    df = spark.createDataFrame([("x",)], "x string")
    chains = [
        Chain("a", F.col("x"), (Step("no_such_step"),)),
        Chain("b", F.col("x"), (Step("anything", proposed="make it nice"),)),
        Chain("c", F.col("x"), (Step("parse_date", {"colour": "red"}),)),
    ]
    row = run_chains(df, chains).select("*", *[error_reason(F.col(f"{n}__error")).alias(n) for n in "abc"]).first()
    assert (row.a, row.b, row.c) == ("unsupported_operation", "new_transformation", "invalid_record")
    assert row.c__error.startswith("parse_date does not take these parameters")
    with pytest.raises(StepError):
        standardise(Value(F.col("x")), "split", {"separator": ""})
    with pytest.raises(StepError):
        date_pattern("%Q", padded=False)


def test_registered_step_is_usable(spark):
    @standardiser("first_letter")
    def first_letter(value):
        return Outcome(F.substring(value.col, 1, 1), "text")

    df = spark.createDataFrame([("word",)], "x string")
    assert run_chains(df, [Chain("c", F.col("x"), (Step("first_letter"),))]).first().c__value == "w"
    REGISTRY.pop("first_letter")


def test_missing_input_is_not_an_error_when_skipped(spark):
    df = spark.createDataFrame([(None,), ("",), ("maybe",)], "x string")
    rows = run_chains(df, [Chain("c", F.col("x"), (Step("normalize_boolean"),))], skip_missing=True).collect()
    assert sorted((r.x or "", r.c__error is not None) for r in rows) == [("", False), ("", False), ("maybe", True)]
