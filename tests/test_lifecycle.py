"""A run that stops for its questions and goes on with the answers."""

import pytest
from pyspark.sql import functions as F

from sourcemeld.contract import contract_from_dict
from sourcemeld.operators import review as V
from sourcemeld.plans.lifecycle import advance, push_run, state
from sourcemeld.sources.readers import read_csv
from sourcemeld.sources.sinks import RunTables, TargetStore

CONTRACT = contract_from_dict(
    {
        "entities": [
            {"entity_name": "person", "fields": [
                {"name": "employee_id", "required": True, "unique": True}, {"name": "first_name", "required": True},
                {"name": "joining_date", "data_type": "date", "required": True}, {"name": "level", "required": True, "enum_values": ["HIGH", "LOW"]},
            ]},
            {"entity_name": "site", "fields": [{"name": "postcode", "required": True, "unique": True}, {"name": "town"}]},
        ]
    }
)


def answer(spark, queue, where, **values):
    """A decision for the one open review that meets a condition."""
    (asked,) = queue.where(where).collect()
    row = {n: None for n in V.DECISION_COLUMNS} | {"decision_id": str(abs(hash(where))), "review_id": asked.review_id, "reason_code": asked.reason_code, "entity": asked.entity, "actor": "clerk"} | values
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} {t}" for n, t in V.DECISION_COLUMNS.items()))
    return df.withColumn("decided_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def test_questions_come_stage_by_stage(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Qx,Zz,Ww,Vv\nE1,Ann,01/02/2020,HIGH\nE2,Bob,02/02/2020,qqq\nE3,,03/02/2020,LOW\n")
    sources, tables = [read_csv(spark, str(tmp_path / "x.csv"))], RunTables(spark, str(tmp_path / "runs"))
    first = advance(spark, tables, "r1", sources, CONTRACT)
    assert (first.stage, first.status) == ("PROFILING", "CONSULTANT_REVIEW") == state(tables, "r1") and first.run.by_entity == {}
    queue = tables.read("queue", ["r1"])
    assert [(r.source_file, r.candidates) for r in queue.collect()] == [("x.csv", ["person", "site"])]
    with pytest.raises(ValueError, match="open reviews"):
        push_run(tables, "r1", first.run, TargetStore(spark, str(tmp_path / "target")))

    wrong = answer(spark, queue, "source_file = 'x.csv'", source_field="x.csv", target_field="planet")
    second = advance(spark, tables, "r1", sources, CONTRACT, wrong)
    assert second.stage == "PROFILING" and [r.problem for r in second.refused.collect()] == ["target is not a candidate"]

    right = answer(spark, tables.read("queue", ["r1"]), "source_file = 'x.csv'", source_field="x.csv", target_field="person")
    third = advance(spark, tables, "r1", sources, CONTRACT, right)
    assert third.stage == "MAPPING" and third.refused.count() == 0 and third.run.by_entity == {}
    queue = tables.read("queue", ["r1"]).cache()
    assert {r.target_field for r in queue.collect()} == {"employee_id", "first_name", "joining_date", "level"} and queue.count() == 4  # gaps, not records

    told = [("employee_id", "Qx"), ("first_name", "Zz"), ("joining_date", "Ww"), ("level", "Vv")]
    answers = [answer(spark, queue, f"target_field = '{t}'", source_field=c, target_field=t) for t, c in told]
    both = answers[0]
    for a in answers[1:]:
        both = both.unionByName(a)
    values = advance(spark, tables, "r1", sources, CONTRACT, both)
    assert values.refused.count() == 0 and values.stage == "MAPPING"
    queue = tables.read("queue", ["r1"])
    assert [(r.reason_code, r.source_field) for r in queue.collect()] == [("unmapped_value", "Vv")]
    assert [r.value for r in tables.read("review_values", ["r1"]).collect()] == ["qqq"]
    fourth = advance(spark, tables, "r1", sources, CONTRACT, answer(spark, queue, "source_field = 'Vv'", source_field="Vv", value_map={"qqq": "LOW"}))
    assert fourth.refused.count() == 0 and fourth.stage == "VALIDATING"
    queue = tables.read("queue", ["r1"])
    assert [(r.reason_code, r.record_key) for r in queue.collect()] == [("invalid_record", "E3")]

    last = advance(spark, tables, "r1", sources, CONTRACT, answer(spark, queue, "record_key = 'E3'", record_key="E3", corrections={"first_name": "Cleo"}))
    assert (last.stage, last.status) == ("VALIDATING", "READY_TO_PUSH") == state(tables, "r1")
    rows = {r.employee_id: (r.first_name, str(r.joining_date), r.level) for r in last.run.by_entity["person"].merged.collect()}
    assert rows == {"E1": ("Ann", "2020-02-01", "HIGH"), "E2": ("Bob", "2020-02-02", "LOW"), "E3": ("Cleo", "2020-02-03", "LOW")}
    store = TargetStore(spark, str(tmp_path / "target"))
    assert push_run(tables, "r1", last.run, store)["person"].run_status == "COMPLETED"
    assert store.current(CONTRACT.entity("person")).count() == 3
    assert tables.read("canonical_person").count() == 3 and tables.read("decisions").count() == 7
