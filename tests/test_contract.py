import json

import pytest

from sourcemeld.contract import ContractError, contract_fields, contract_relationships, load_contract


def spec(**entity):
    return {"entities": [{"entity_name": "employee", "fields": [{"name": "id", "data_type": "string"}], **entity}]}


def test_json_and_yaml_agree():
    text = json.dumps(spec(source_precedence=["a.csv"], fields=[{"name": "id", "aliases": None, "unique": True}]))
    assert load_contract("c.json", text) == load_contract("c.yaml", text)
    assert load_contract("c.json", text).entity("employee").field("id").aliases == ()


@pytest.mark.parametrize(
    "name, text",
    [
        ("c.txt", "{}"),
        ("c.json", "{"),
        ("c.yaml", "a: [1"),
        ("c.json", json.dumps({"entities": []})),
        ("c.json", json.dumps(spec(fields=[]))),
        ("c.json", json.dumps(spec(fields=[{"name": "mail", "data_type": "email"}]))),
        ("c.json", json.dumps({"entities": spec()["entities"] + [{"entity_name": " Employee", "fields": [{"name": "x"}]}]})),
    ],
)
def test_refused(name, text):
    with pytest.raises(ContractError):
        load_contract(name, text)


def test_tables(spark):
    payload = spec(relationships=[{"field": "id", "references_entity": "department", "references_field": "id"}])
    payload["entities"].append({"entity_name": "department", "fields": [{"name": "id", "required": True}]})
    contract = load_contract("c.json", json.dumps(payload))
    assert contract_fields(spark, contract).count() == 2
    assert contract_relationships(spark, contract).first().references_entity == "department"
