"""Registered corpus queries: those with SQL against it, the others against brute force over the given table."""

import hashlib

import pytest
from oracle import connect, difference
from test_duplicates import brute_repeats

import __spark_entry__ as entry_point
from sourcemeld.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), connect(SF_DIR), SQL[name]) is None


def test_repeat_removal_over_the_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    want = {(i, sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, spans, kept in brute_repeats(rows, 50)}
    got = {(r["doc_id"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op8_repeat_removal"](spark, SF_DIR).collect()}
    assert got == want


def test_all_are_registered():
    names = set(entry_point.queries())
    assert set(QUERIES) <= names
    assert {f"op{n}_" for n in range(1, 14)} == {x.split("_")[0] + "_" for x in QUERIES} and "pipeline" in names
