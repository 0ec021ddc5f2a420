"""Columns meet their candidates once: a catalog of a million files is not multiplied by candidates or entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcemeld.operators import matching as M
from sourcemeld.session import Scratch
from workload import matching as W


def test_a_column_is_one_row(spark, tmp_path):
    contract = W.trade_contract()
    columns = ["Cust No", "Mail Address", "Note 1"]
    catalog = spark.createDataFrame(
        [(f"crm-{k}.csv", c, i, "string") for k in range(3) for i, c in enumerate(columns)], "source_file string, column string, ordinal int, inferred_type string"
    )
    scores = Scratch(spark).write(M.label_scores(M.distinct_labels(catalog), contract), "scores")
    entities = M.detect_entities(catalog, contract, scores)
    choices = M.column_candidates(catalog, entities, M.match_candidates(scores, contract))
    assert choices.count() == 9
    proposals = spark.createDataFrame(
        [("customer", "Note 1", "nothing", False, 0.9), ("customer", "Note 1", "phone", True, 0.8)],
        "entity string, source_column string, target_field string, needs_review boolean, confidence double",
    )
    mapping = M.decide_fields(choices, proposals)
    assert mapping.count() == 9 and mapping.where("decision = 'proposed'").isEmpty()
    assert mapping.where(F.size("alternatives") != 2).isEmpty()


def test_entities_are_ranked_in_one_row_per_file(spark):
    contract = W.trade_contract()
    catalog = spark.createDataFrame([("orders_1.csv", "order_id", 0, "integer"), ("orders_1.csv", "cust_id", 1, "integer")], "source_file string, column string, ordinal int, inferred_type string")
    scored = M.entity_scores(catalog, contract)
    assert scored.columns == ["source_file", "entity", "entity_ordinal", "score"] and scored.count() == len(contract.entities)
    assert "Window" not in M.entity_scores(catalog, contract)._jdf.queryExecution().optimizedPlan().toString()
