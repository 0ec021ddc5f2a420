"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as entry_point
from oracle import connect, difference
from workload import cleaning, matching, records

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


OWN = [name for module in (cleaning, matching, records) for name in module.QUERIES]


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, con, name):
    df = entry_point.queries()[name](spark, SF_DIR)
    assert difference(df, con, entry_point.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_answers_to_one_review_are_not_paired_with_partitions_of_the_queue(spark):
    plan = entry_point.queries()["resolution_rows"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan
