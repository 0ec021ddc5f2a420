from pyspark.sql import functions as F

from sourcemeld.contract import contract_from_dict
from sourcemeld.functions.similarity import cosine, native_ratio, ratio, token_set_ratio
from sourcemeld.operators import matching as M
from sourcemeld.operators.planning import default_steps, enum_plan, plan_steps
from sourcemeld.contract import Field


def contract(*fields, **more):
    return contract_from_dict({"entities": [{"entity_name": "employee", "fields": list(fields), **more}]})


def catalog(spark, columns, name="f.csv", kinds=None):
    rows = [(name, c, i, (kinds or {}).get(c, "string")) for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "source_file string, column string, ordinal int, inferred_type string")


def decide(spark, cat, c, **more):
    scores = M.label_scores(M.distinct_labels(cat), c)
    entities = M.detect_entities(cat, c, scores)
    rows = M.decide_fields(M.column_candidates(cat, entities, M.match_candidates(scores, c)), **more).collect()
    return {r.source_column: r for r in rows}


def test_similarity_definitions(spark):
    rows = [
        ("kitten", "sitting", 8 / 13, 8 / 13),
        ("new york mets", "york new mets", None, 1.0),
        ("order", "order date", 10 / 15, 1.0),
        ("a b c", "c b d", None, 0.8),
        ("", "x", 0.0, 0.0),
    ]
    df = spark.createDataFrame([(a, b) for a, b, *_ in rows], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(ratio(a, b).alias("r"), native_ratio(a, b).alias("n"), token_set_ratio(a, b).alias("t"), token_set_ratio(a, b, native_ratio).alias("tn")).collect()
    for (_, _, r, t), row in zip(rows, got):
        assert abs(row.r - row.n) < 1e-12 and abs(row.t - row.tn) < 1e-12
        assert r is None or abs(row.r - r) < 1e-12
        assert abs(row.t - t) < 1e-12


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    values = [r.c for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert abs(values[0] - 0.5**0.5) < 1e-12 and values[1] == 0.0


def test_alias_beats_shared_alias_order(spark):
    c = contract(
        {"name": "employee_id", "aliases": ["emp id", "staff id"]}, {"name": "first_name", "aliases": ["given name"]},
        {"name": "department", "aliases": ["dept", "org"]}, {"name": "business_unit", "aliases": ["org"]},
    )
    got = decide(spark, catalog(spark, ["Staff ID", "Given Name", "Dept", "org", "qqxx"]), c)
    assert {k: v.target_field for k, v in got.items()} == {
        "Staff ID": "employee_id", "Given Name": "first_name", "Dept": "department", "org": "department", "qqxx": None,
    }
    assert got["org"].match == "exact alias" and got["qqxx"].decision == "dropped"


def test_incompatible_type_is_dropped_unless_exact(spark):
    c = contract({"name": "joining_date", "data_type": "date"}, {"name": "grade"})
    got = decide(spark, catalog(spark, ["joining dates", "grade"], kinds={"joining dates": "integer", "grade": "integer"}), c)
    assert got["joining dates"].target_field is None and got["grade"].target_field == "grade"


def test_proposals_and_overrides(spark):
    c = contract({"name": "department", "aliases": ["org"]}, {"name": "business_unit", "aliases": ["org"]}, {"name": "salary"})
    cat = catalog(spark, ["org_area"])
    before = decide(spark, cat, c)["org_area"]
    assert before.decision == "fallback"
    columns = "entity string, source_column string, target_field string, needs_review boolean"
    right = spark.createDataFrame([("employee", "org_area", "business_unit", False)], columns)
    wrong = spark.createDataFrame([("employee", "org_area", "made_up", False)], columns)
    assert decide(spark, cat, c, proposals=right)["org_area"].target_field == "business_unit"
    assert decide(spark, cat, c, proposals=wrong)["org_area"].target_field == before.target_field
    told = decide(spark, cat, c, overrides=right.drop("needs_review"))["org_area"]
    assert (told.decision, told.confidence) == ("override", 1.0)


def test_two_entities_are_told_apart(spark):
    c = contract_from_dict(
        {
            "entities": [
                {"entity_name": "employee", "fields": [{"name": "employee_id", "aliases": ["emp id"]}, {"name": "first_name"}, {"name": "email"}]},
                {"entity_name": "department", "fields": [{"name": "department_id", "aliases": ["dept id"]}, {"name": "department_name", "aliases": ["dept name"]}]},
            ]
        }
    )
    cat = catalog(spark, ["Emp ID", "First Name", "Email"], "people.csv").unionByName(catalog(spark, ["Dept ID", "Dept Name"], "units.csv"))
    assert {r.source_file: r.entity for r in M.detect_entities(cat, c).collect()} == {"people.csv": "employee", "units.csv": "department"}


def test_steps_follow_type_name_and_values():
    def ops(field, facts=None):
        return [s.operation for s in plan_steps(field, facts or {}, default_steps(field))]

    assert ops(Field("joined", "date")) == ["parse_date_auto"]
    assert ops(Field("seen", "datetime")) == ["parse_datetime_auto"]
    assert ops(Field("work_email")) == ["normalize_email"]
    assert ops(Field("phone")) == ["normalize_phone"]
    assert ops(Field("salary", "number"), {"noisy_number": True}) == ["normalize_decimal", "trim"]
    assert ops(Field("salary", "number")) == ["trim"]
    assert ops(Field("active", "boolean")) == ["normalize_boolean", "trim"]
    tags = plan_steps(Field("tags", "array"), {"has_pipe": True}, default_steps(Field("tags", "array")))
    assert (tags[0].operation, tags[0].params) == ("split", {"separator": "|"})


def test_enum_tiers(spark):
    values = spark.createDataFrame([("Active",), ("Currently Working",), ("former-staff",), ("ACTIV",), ("???",)], "value string")
    got = {r.value: (r.target, r.tier) for r in enum_plan(values, ["ACTIVE", "INACTIVE"]).collect()}
    assert got == {
        "Active": ("ACTIVE", "equal"), "Currently Working": ("ACTIVE", "word"), "former-staff": ("INACTIVE", "word"),
        "ACTIV": ("ACTIVE", "lexical"), "???": (None, "unresolved"),
    }
