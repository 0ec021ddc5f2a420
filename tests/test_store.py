"""The target store: buckets, types, commits of several writers, merging; tables of runs."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle import difference
from sourcemeld.contract import contract_from_dict
from sourcemeld.operators.push import push_outcomes
from sourcemeld.plans.deliver import push_batch
from sourcemeld.sources import sinks
from sourcemeld.sources.sinks import Conflict, RunTables, TargetStore
from workload import records

KINDS = {"n": "integer", "x": "number", "flag": "boolean", "day": "date", "at": "datetime", "tags": "array", "more": "object", "name": "string"}
CONTRACT = contract_from_dict({"entities": [{"entity_name": "thing", "fields": [{"name": n, "data_type": t} for n, t in KINDS.items()]}]})
THING = CONTRACT.entity("thing")


def batch(spark, ids, name="a", run="r"):
    rows = [(f"k{i}", f"{run}:{i}", f"{i:04d}", str(i), "1.5", "true", "2024-02-03", "2024-02-03T04:05:06Z", '["p", "q"]', '{"u": [1, {"v": null}]}', name) for i in ids]
    return spark.createDataFrame(rows, "record_key string, idem_key string, record_id string, " + ", ".join(f"{n} string" for n in KINDS))


def rows(df):
    return {r["record_key"]: r["name"] for r in df.collect()}


def test_rows_come_back_in_their_types(spark, tmp_path):
    store = TargetStore(spark, str(tmp_path), buckets=4)
    store.write(THING, batch(spark, [7]))
    r = store.current(THING).withColumn("more", F.to_json("more")).first()
    assert (r["n"], r["x"], r["flag"], r["day"], r["at"]) == (7, 1.5, True, datetime.date(2024, 2, 3), datetime.datetime(2024, 2, 3, 4, 5, 6))
    assert r["tags"] == ["p", "q"] and r["more"] == '{"u":[1,{"v":null}]}'
    store.write(THING, store.current(THING).withColumns({"idem_key": F.lit("again"), "record_id": F.lit("9"), "name": F.lit("typed rows go in as well")}))
    assert rows(store.current(THING)) == {"k7": "typed rows go in as well"}


def test_last_write_wins_and_deletes_take_the_ledger_along(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "COMPACT_AFTER", 3)
    store = TargetStore(spark, str(tmp_path), buckets=4)
    want, ledger = {}, {}
    steps = [("w", range(6), "a", "r1"), ("w", range(3, 9), "b", "r2"), ("d", [0, 4], None, None), ("w", [4], "c", "r3"), ("d", [5], None, None), ("w", [0, 1], "d", "r1"), ("w", [5], "e", "r4")]
    for kind, ids, name, run in steps:
        if kind == "w":
            store.write(THING, batch(spark, ids, name, run))
            want |= {f"k{i}": name for i in ids}
            ledger |= {f"{run}:{i}": f"k{i}" for i in ids}
        else:
            store.delete(THING, spark.createDataFrame([(f"k{i}",) for i in ids], "record_key string"))
            want = {k: v for k, v in want.items() if k not in {f"k{i}" for i in ids}}
            ledger = {k: v for k, v in ledger.items() if v not in {f"k{i}" for i in ids}}
        assert rows(store.current(THING)) == want
        assert {r["idem_key"]: r["record_key"] for r in store.ledger(THING).collect()} == ledger
    assert store.snapshot(THING).merged is not None and len(store.snapshot(THING).later) < 3
    assert rows(store.current(THING, "k1")) == {"k1": "d"} and rows(store.current(THING, "nobody")) == {}
    assert rows(TargetStore(spark, str(tmp_path), buckets=99).current(THING)) == want  # buckets are fixed by the first writer


def test_a_batch_opens_only_its_buckets(spark, tmp_path):
    store = TargetStore(spark, str(tmp_path), buckets=16)
    store.write(THING, batch(spark, range(400)))
    one = batch(spark, [11])
    for df, key in ((store.ledger(THING, one), "idem_key"), (store.changes(THING, one), "record_key")):
        (bucket,) = store._touched(one, key, THING)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f"(bucket#" in plan.split("PartitionFilters: [", 1)[1].split("]")[0] and f"= {bucket})" in plan
    files = store.changes(THING, one).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r["f"].split("bucket=")[1].split("/")[0] for r in files} == {str(store._touched(one, "record_key", THING)[0])}
    assert rows(store.alive(THING, one).select("record_key", "payload.name").where("record_key = 'k11'")) == {"k11": "a"}


def test_two_writers_never_overwrite_each_other(spark, tmp_path, scratch):
    one, two = TargetStore(spark, str(tmp_path), buckets=64), TargetStore(spark, str(tmp_path), buckets=64)
    seen = one.version(THING)
    mine, theirs = batch(spark, [1]), batch(spark, [2])
    two.write(THING, theirs, base=two.version(THING))
    one.write(THING, mine, base=seen)  # other buckets: goes on to the next number
    assert rows(one.current(THING)) == {"k1": "a", "k2": "a"} and one.version(THING) == 2
    seen = one.version(THING)
    two.write(THING, batch(spark, [1], "other", "r"))
    with pytest.raises(Conflict):
        one.write(THING, batch(spark, [1], "late", "r"), base=seen)
    assert rows(one.current(THING))["k1"] == "other"


def test_a_batch_that_lost_a_race_is_judged_anew(spark, tmp_path, scratch, monkeypatch):
    store, rival = TargetStore(spark, str(tmp_path)), TargetStore(spark, str(tmp_path))
    write, raced = store.write, []

    def late(entity, accepted, base=None):
        if not raced:
            raced.append(rival.write(entity, batch(spark, [1, 2], "rival")))
        return write(entity, accepted, base)

    monkeypatch.setattr(store, "write", late)
    outcomes = push_batch(scratch.write(batch(spark, [1, 2, 3], "mine"), "b"), store, THING, scratch)
    assert {r["record_key"]: r["outcome"] for r in outcomes.collect()} == {"k1": "idempotent_replay", "k2": "idempotent_replay", "k3": "accepted"}
    assert rows(store.current(THING)) == {"k1": "rival", "k2": "rival", "k3": "mine"}
    assert push_outcomes(batch(spark, [1]), store.ledger(THING)).first()["outcome"] == "idempotent_replay"


def test_unfinished_writes_are_not_seen(spark, tmp_path, monkeypatch):
    store = TargetStore(spark, str(tmp_path))
    store.write(THING, batch(spark, [1]))
    monkeypatch.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.write(THING, batch(spark, [2]))
    assert rows(TargetStore(spark, str(tmp_path)).current(THING)) == {"k1": "a"}


def test_a_second_attempt_replaces_the_tables_of_a_run(spark, tmp_path):
    tables = RunTables(spark, str(tmp_path))
    first = spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int")
    tables.save("run1", {"records": first, "reviews": first.limit(1)})
    tables.save("run2", {"records": first.where("n = 2")})
    held = tables.read("records").where("run_id = 'run1'")  # a reader that has begun keeps what it saw
    tables.save("run1", {"records": first.where("n = 1"), "reviews": first.limit(0)})
    assert sorted((r["run_id"], r["key"]) for r in tables.read("records").collect()) == [("run1", "a"), ("run2", "b")]
    assert held.count() == 2 and tables.read("reviews", ["run1"]).count() == 0 and tables.runs() == ["run1", "run2"]
    with pytest.raises(Exception, match="half way"):
        tables.save("run1", {"records": spark.range(1).select(F.raise_error(F.lit("half way")).cast("string").alias("key"))})
    assert sorted(r["key"] for r in tables.read("records", ["run1"]).collect()) == ["a"]


@pytest.mark.parametrize("name", ["retry_failed", "store_retry"])
def test_a_refused_record_goes_through_whatever_the_ledger_knows(spark, tmp_path, name):
    """Customer 17 was written by an earlier run, is refused under the same key and has no order that would hide it."""
    for t in ("customer", "orders"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        rows.where("o_custkey <> 17" if t == "orders" else "true").write.parquet(f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert difference(records.QUERIES[name](spark, str(tmp_path)), con, records.SQL[name]) is None


def test_a_key_written_again_has_one_ledger_entry(spark, tmp_path, scratch):
    store = TargetStore(spark, str(tmp_path))
    for key in ("old", "new"):
        payload = batch(spark, [1]).withColumn("record_key", F.lit(key))
        push_batch(scratch.write(payload, "b"), store, THING, scratch, failed=F.lit(key == "new"))
    assert [r["record_key"] for r in store.ledger(THING).collect()] == ["new"]
    assert push_outcomes(batch(spark, [1]), store.ledger(THING)).count() == 1
