"""The whole run on small files: golden records, decisions, delivery."""

import json

import pytest
from pyspark.sql import functions as F

from sourcemeld.contract import load_contract
from sourcemeld.functions.steps import Step
from sourcemeld.operators import review as V
from sourcemeld.operators.results import run_stats
from sourcemeld.operators.skew import lookup_join
from sourcemeld.operators.standardise import Mapped, standardise_source
from sourcemeld.plans import deliver
from sourcemeld.plans.reconcile import Decisions, run
from sourcemeld.sources.readers import read_csv
from sourcemeld.sources.sinks import AuditTrail, TargetStore
from sourcemeld.streaming.feed import push_stream

# Two messy files and the records they must give.
LEGACY = """Emp ID,First Name,Last Name,Email Address,DOB,DOJ,Dept,Status
E1024,John,Smith,john.smith@abc.com,15/07/1998,01/08/2022,Engineering,Active
E1025,Ana,Patel,ana.patel@abc.com,02/03/1997,12/09/2021,Finance,Active
E1026,Rahul,Verma,rahul.verma@abc.com,11/11/1996,05/01/2020,Engineering,Active
E1027,Meera,Rao,meera.rao@abc.com,10/10/1999,20/02/2023,Corporate Services,Active
E-FAIL,Demo,Failure,demo.failure@abc.com,01/01/1995,01/01/2024,QA,Active
"""
CRM = """Staff ID,Given Name,Surname,Email,Mobile,Birth Date,Team
E1024,John,Smith,john.smith@abc.com,9876543210,1998-07-15,Engineering
E1025,Ana,Patel,ANA.PATEL@ABC.COM,+91 9988776655,1997-03-02,Finance
E1026,Rahul,Verma,rahul.verma@abc.com,9999999999,1996-11-11,Engineering
E1027,Meera,Rao,meera.rao@abc.com,9888888888,1999-10-10,Corporate Services
"""
GOLDEN = {
    "E1024": ("John", "Smith", "john.smith@abc.com", "9876543210", "1998-07-15", "2022-08-01", "Engineering", "ACTIVE", 2),
    "E1025": ("Ana", "Patel", "ana.patel@abc.com", "919988776655", "1997-03-02", "2021-09-12", "Finance", "ACTIVE", 2),
    "E1026": ("Rahul", "Verma", "rahul.verma@abc.com", "9999999999", "1996-11-11", "2020-01-05", "Engineering", "ACTIVE", 2),
    "E1027": ("Meera", "Rao", "meera.rao@abc.com", "9888888888", "1999-10-10", "2023-02-20", "Corporate Services", "ACTIVE", 2),
    "E-FAIL": ("Demo", "Failure", "demo.failure@abc.com", None, "1995-01-01", "2024-01-01", "QA", "ACTIVE", 1),
}


def field(name, *aliases, kind="string", **more):
    return {"name": name, "aliases": list(aliases), "data_type": kind, **more}


def employee_contract(precedence=("legacy_hr.csv", "crm.csv")):
    fields = [
        field("employee_id", "emp id", "employee number", "staff id", required=True, unique=True),
        field("first_name", "given name", "fname", required=True),
        field("last_name", "surname", "family name", required=True),
        field("email", "work email", "email address", required=True, unique=True),
        field("phone", "mobile", "phone number"),
        field("date_of_birth", "dob", "birth date", kind="date"),
        field("joining_date", "date of joining", "doj", "start date", kind="date", required=True),
        field("department", "dept", "team", "organisation", "org", required=True),
        field("employment_status", "status", required=True, enum_values=["ACTIVE", "INACTIVE"]),
    ]
    payload = {"entities": [{"entity_name": "employee", "source_precedence": list(precedence), "fields": fields}]}
    return load_contract("c.json", json.dumps(payload))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    (folder / "legacy_hr.csv").write_text(LEGACY)
    (folder / "crm.csv").write_text(CRM)
    (folder / "crm_clash.csv").write_text(CRM.replace("1998-07-15,Engineering", "1998-07-15,Finance").replace("rahul.verma@abc.com", "nobody"))
    return folder


@pytest.fixture(scope="module")
def done(spark, files):
    return run(spark, [read_csv(spark, str(files / n)) for n in ("legacy_hr.csv", "crm.csv")], employee_contract())


def values(merged):
    names = ["first_name", "last_name", "email", "phone", "date_of_birth", "joining_date", "department", "employment_status", "n_members"]
    return {r.record_key: tuple(r[n] for n in names) for r in merged.collect()}


def test_golden_records(spark, done):
    employee = done.by_entity["employee"]
    assert values(employee.merged) == GOLDEN
    assert {r.status: r["count"] for r in employee.status.groupBy("status").count().collect()} == {"READY_TO_PUSH": 5, "RECONCILED": 4}
    assert done.reviews.count() == 0 and done.unresolved.count() == 0
    stats = run_stats(employee.status, done.reviews).first()
    assert (stats.files, stats.records, stats.reviews, stats.ready_to_push) == (2, 9, 0, 5)


def test_push_retry_replay_rollback(spark, done, tmp_path):
    employee = done.by_entity["employee"]
    store, audit = TargetStore(spark, str(tmp_path / "target")), AuditTrail(spark, str(tmp_path / "audit"))
    with pytest.raises(ValueError):
        deliver.push(employee, store, "run1", open_reviews=1)
    refuse = F.col("record_key").endswith("FAIL")
    first = deliver.push(employee, store, "run1", 0, reject=refuse, audit=audit)
    assert first.run_status == "PARTIAL_FAILURE"
    assert {r.outcome: r["count"] for r in first.outcomes.groupBy("outcome").count().collect()} == {"accepted": 4, "rejected": 1}
    assert store.current(employee.entity).count() == 4
    second = deliver.retry(employee, first.status, store, "run1", audit=audit)
    assert second.run_status == "COMPLETED" and store.current(employee.entity).count() == 5
    assert store.current(employee.entity, "E1025").first().department == "Finance"
    before = sorted(map(tuple, store.current(employee.entity).collect()))
    again = deliver.push(employee, store, "run1", 0)
    assert {r.outcome for r in again.outcomes.collect()} == {"idempotent_replay"}
    assert sorted(map(tuple, store.current(employee.entity).collect())) == before
    other = deliver.push(employee, store, "run2", 0)
    assert {r.outcome for r in other.outcomes.collect()} == {"accepted"}
    assert sorted(map(tuple, store.current(employee.entity).collect())) == before
    after = deliver.rollback(employee, second.status, store, "run1", audit)
    assert store.current(employee.entity).count() == 0 and store.ledger(employee.entity).count() == 0
    assert after.where("status = 'ROLLED_BACK'").count() == 5
    actions = [r.action for r in audit.read("run1").collect()]
    assert actions.count("TARGET_PUSHED") == 5 and actions.count("TARGET_PUSH_FAILED") == 1 and actions[-1] == "ROLLBACK_COMPLETE"
    assert deliver.push(employee, store, "run1", 0).run_status == "COMPLETED"
    assert store.current(employee.entity).count() == 5


def decision(spark, **values):
    row = {n: None for n in V.DECISION_COLUMNS} | values
    schema = ", ".join(f"{n} {t}" for n, t in V.DECISION_COLUMNS.items())
    text = dict(row, decided_at=None)
    df = spark.createDataFrame([tuple(text[n] for n in V.DECISION_COLUMNS)], schema)
    return df.withColumn("decided_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def test_conflict_is_reviewed_corrected_and_gone(spark, files):
    contract = employee_contract(precedence=["legacy_hr.csv"])
    sources = [read_csv(spark, str(files / n)) for n in ("legacy_hr.csv", "crm_clash.csv")]
    first = run(spark, sources, contract)
    clashes = {(r.record_key, r.field) for r in first.reviews.where("reason_code = 'conflicting_values'").collect()}
    assert clashes == {("E1024", "department"), ("E1026", "email")}
    items = V.with_review_id(first.reviews)
    queue = V.review_queue(items)
    review_id = queue.where("field = 'department'").first().review_id
    fix = decision(
        spark, decision_id="d1", review_id=review_id, reason_code="conflicting_values", entity="employee", record_key="E1024",
        corrections={"department": "Research"}, actor="clerk",
    )
    accepted, refused = V.split_decisions(V.check_decisions(fix, queue))
    assert refused.count() == 0
    second = run(spark, sources, contract, Decisions(accepted=accepted))
    merged = {r.record_key: r for r in second.by_entity["employee"].merged.collect()}
    assert merged["E1024"].department == "Research" and merged["E1024"].group_status == "READY_TO_PUSH"
    assert merged["E1026"].group_status == "CONSULTANT_REVIEW"
    assert [(r.record_key, r.data) for r in second.audit.where("action = 'CONFLICT_RESOLUTION_APPLIED'").collect()] == [("E1024", "Research")]


def test_gaps_unmapped_values_and_overrides(spark, tmp_path):
    (tmp_path / "staff.csv").write_text("Staff ID,First Name,Last Name,Email,Began,Dept,Status\nE1,A,B,a@x,01/02/2020,IT,Active\nE2,C,D,c@x,02/02/2020,IT,qqq\nE3,E,F,e@x,bad,IT,left\n")
    source = [read_csv(spark, str(tmp_path / "staff.csv"))]
    contract = employee_contract()
    first = run(spark, source, contract)
    reviews = first.reviews.collect()
    gap = [r for r in reviews if r.reason_code == "ambiguous_mapping"]
    assert [(r.target_field, "Began" in r.available_source_fields) for r in gap] == [("joining_date", True)]
    assert [r.unresolved_value for r in first.unresolved.collect()] == ["qqq"]
    unmapped = [r for r in reviews if r.reason_code == "unmapped_value"]
    assert [(r.source_field, r.unresolved_values) for r in unmapped] == [("Status", ["qqq"])]
    mapping = decision(spark, decision_id="d1", review_id="x", reason_code="ambiguous_mapping", entity="employee", source_field="Began", target_field="joining_date")
    answer = decision(spark, decision_id="d2", review_id="y", reason_code="unmapped_value", entity="employee", source_field="Status", value_map={"qqq": "INACTIVE"})
    second = run(spark, source, contract, Decisions(accepted=mapping.unionByName(answer)))
    merged = {r.record_key: r for r in second.by_entity["employee"].merged.collect()}
    assert (merged["E1"].joining_date, merged["E2"].employment_status, merged["E3"].employment_status) == ("2020-02-01", "INACTIVE", "INACTIVE")
    left = {(r.reason_code, r.record_key) for r in second.reviews.collect()}
    assert left == {("invalid_record", "E3")}


def test_doubtful_pairs_are_settled_by_decisions(spark, tmp_path):
    head = "Staff ID,First Name,Last Name,Email,Mobile,DOJ,Dept,Status\n"
    rows = ["E1,Jonathan,Miller,,555,01/02/2020,IT,Active", "E2,Johnathan,Millar,,555,01/02/2020,IT,Active", "E3,Jonatan,Miler,,555,01/02/2020,IT,Active"]
    (tmp_path / "staff.csv").write_text(head + "\n".join(rows) + "\n")
    source, contract = [read_csv(spark, str(tmp_path / "staff.csv"))], employee_contract()
    first = run(spark, source, contract)
    doubtful = {r.record_key: r for r in V.with_review_id(first.reviews).where("reason_code = 'ambiguous_match'").collect()}
    assert set(doubtful) == {"E1", "E2", "E3"}
    ids = {k: r.record_id for k, r in doubtful.items()}
    queue = V.review_queue(first.reviews)

    def verdict(key, partner, word):
        return decision(
            spark, decision_id=f"{key}{partner}", review_id=doubtful[key].review_id, reason_code="ambiguous_match", entity="employee",
            record_id=ids[key], value_map={partner: word}, actor="clerk",
        )

    partner = doubtful["E2"].candidates[0]
    told = verdict("E2", partner, "same").unionByName(verdict("E3", doubtful["E3"].candidates[0], "perhaps")).unionByName(verdict("E1", "nobody", "same"))
    problems = {r.decision_id: r.problem for r in V.check_decisions(told, queue).collect()}
    assert sorted(problems.values(), key=str) == [None, "a pair is same or different", "record is not the partner"]
    accepted, _ = V.split_decisions(V.check_decisions(told, queue))
    second = run(spark, source, contract, Decisions(accepted=accepted))
    groups = {r.record_id: r.group_id for r in second.by_entity["employee"].members.collect()}
    assert groups[ids["E2"]] == groups[partner] and len(set(groups.values())) == 2


def test_folder_of_files_is_one_plan(spark, tmp_path):
    lines = LEGACY.strip().split("\n")
    folder = tmp_path / "hr"
    folder.mkdir()
    (folder / "a.csv").write_text("\n".join([lines[0], *lines[1:3]]) + "\n")
    (folder / "b.csv").write_text("\n".join([lines[0], *lines[3:]]) + "\n")
    (tmp_path / "crm.csv").write_text(CRM)
    done = run(spark, [read_csv(spark, str(folder)), read_csv(spark, str(tmp_path / "crm.csv"))], employee_contract(["a.csv", "b.csv", "crm.csv"]))
    assert values(done.by_entity["employee"].merged) == GOLDEN


def test_large_value_maps_are_joined(spark, tiny_limits):
    entity = employee_contract().entity("employee")
    df = spark.createDataFrame([("f#1", "f", 2, " a "), ("f#2", "f", 3, "zz"), ("f#3", "f", 4, None)], "record_id string, source_file string, source_row_number long, s string")
    value_map = spark.createDataFrame([("a", "ACTIVE"), ("b", "INACTIVE")], "value string, target string")
    out = standardise_source(df, entity, [Mapped("s", "employment_status", (Step("trim"),), value_map, 2_000_000)])
    rows = {r.record_id: (r.employment_status, [e.error for e in r.step_errors]) for r in out.collect()}
    assert rows == {"f#1": ("ACTIVE", []), "f#2": (None, ["unmapped_value"]), "f#3": (None, [])}


def test_lookup_join_with_hot_keys(spark):
    big = spark.range(1000).withColumn("k", F.when(F.col("id") < 400, "hot").otherwise(F.col("id").cast("string")))
    lookup = big.groupBy("k").agg(F.min("id").alias("low")).where("low % 3 <> 1")
    plain = sorted(map(tuple, big.join(lookup, "k", "left").select("id", "k", "low").collect()), key=repr)
    split = lookup_join(big, lookup, "k", rows=1000, hot_rows=100)
    assert sorted(map(tuple, split.select("id", "k", "low").collect()), key=repr) == plain


def test_stream_delivers_once(spark, tmp_path):
    entity = employee_contract().entity("employee")
    store = TargetStore(spark, str(tmp_path / "target"))
    rows = spark.range(20).select(
        F.concat(F.lit("r"), "id").alias("record_id"), F.concat(F.lit("E"), F.col("id") % 15).alias("employee_id"),
        *[F.lit(n).alias(n) for n in entity.names if n != "employee_id"],
    )
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for attempt in ("one", "two"):
        query = push_stream(stream, store, entity, "run", ("employee_id",)).option("checkpointLocation", str(tmp_path / attempt)).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
    assert store.current(entity).count() == 15 and store.ledger(entity).count() == 20
    assert store.changes(entity).count() == 20


def test_fields_may_be_called_like_the_engines_columns(spark, tmp_path):
    names = ["record_id", "status", "method", "group_id", "record_key"]
    fields = [field("record_id", required=True, unique=True), field("status", required=True, enum_values=["ON", "OFF"]), field("method"), field("group_id", required=True), field("record_key")]
    contract = load_contract("c.json", json.dumps({"entities": [{"entity_name": "thing", "fields": fields}]}))
    (tmp_path / "a.csv").write_text("record_id,status,method,group_id,record_key\nT1,ON,post,g1,k1\nT2,off,mail,,k2\n")
    (tmp_path / "b.csv").write_text("record_id,status,method,group_id\nT1,ON,fax,g1\n")
    sources = [read_csv(spark, str(tmp_path / n)) for n in ("a.csv", "b.csv")]
    done = run(spark, sources, contract)
    asked = {(r.reason_code, r.record_key, r.field or r.violations[0].field) for r in done.reviews.collect()}
    assert asked == {("conflicting_values", "T1", "method"), ("invalid_record", "T2", "group_id")}
    assert {(r.field, r.value) for r in done.conflict_values.collect()} == {("method", "post"), ("method", "fax")}
    fixes = decision(spark, decision_id="d1", review_id="x", reason_code="conflicting_values", entity="thing", record_key="T1", corrections={"method": "phone"})
    fixes = fixes.unionByName(decision(spark, decision_id="d2", review_id="y", reason_code="invalid_record", entity="thing", record_key="T2", corrections={"group_id": "g2"}))
    again = run(spark, sources, contract, Decisions(accepted=fixes))
    thing, store = again.by_entity["thing"], TargetStore(spark, str(tmp_path / "target"))
    assert again.reviews.count() == 0 and deliver.push(thing, store, "run", again.reviews, key_fields=("record_id",)).run_status == "COMPLETED"
    rows = store.current(thing.entity).select("record_key", *[n if n != "record_key" else "record_key__field" for n in names]).collect()
    assert sorted(map(tuple, rows)) == [("T1", "T1", "ON", "phone", "g1", "k1"), ("T2", "T2", "OFF", "mail", "g2", "k2")]


@pytest.mark.parametrize("rows", [1, 10**9])
def test_value_maps_answer_alike_at_every_size(spark, rows):
    from sourcemeld.contract import Entity, Field

    values = ["qqq", "QQQ", " qqq ", "", None, "zzz"]
    df = spark.createDataFrame([(str(i), "f", i, v) for i, v in enumerate(values)], "record_id string, source_file string, source_row_number long, raw string")
    answers = spark.createDataFrame([("qqq", "A"), ("other", None)], "value string, target string")
    out = standardise_source(df, Entity("e", (Field("level", "string"),)), [Mapped("raw", "level", (Step("trim"),), answers, rows)])
    got = {r.record_id: (r.level, [e.error for e in r.step_errors]) for r in out.collect()}
    assert got == {"0": ("A", []), "1": ("A", []), "2": ("A", []), "3": (None, []), "4": (None, []), "5": (None, ["unmapped_value"])}


def test_a_failed_optional_step_holds_the_group(spark, tmp_path):
    (tmp_path / "legacy_hr.csv").write_text(LEGACY.replace("15/07/1998", "no date at all"))
    done = run(spark, [read_csv(spark, str(tmp_path / "legacy_hr.csv"))], employee_contract())
    status = {r.employee_id: r.group_status for r in done.by_entity["employee"].merged.collect()}
    assert status["E1024"] == "CONSULTANT_REVIEW" and status["E1025"] == "READY_TO_PUSH"
