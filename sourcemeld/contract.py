"""The target contract: entities, their fields and relationships."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sourcemeld.settings import TYPES


class ContractError(ValueError):
    pass


#: Columns that the engine keeps beside the contract's fields.
ENGINE_COLUMNS = frozenset(
    "record_id source_file source_row_number step_errors status arrival group_id method record_key idem_key n_members primary_id source_files "
    "conflicts open_conflicts corrected violations group_status open_errors".split()
)


def column(field: str) -> str:
    """Column that holds a contract field: its name, set apart where the engine has a column of that name."""
    return f"{field}__field" if field in ENGINE_COLUMNS else field


@dataclass(frozen=True)
class Field:
    name: str
    data_type: str = "string"
    required: bool = False
    unique: bool = False
    aliases: tuple[str, ...] = ()
    enum_values: tuple[str, ...] = ()
    example_values: tuple[str, ...] = ()
    description: str = ""


@dataclass(frozen=True)
class Relationship:
    field: str
    references_entity: str
    references_field: str


@dataclass(frozen=True)
class Entity:
    name: str
    fields: tuple[Field, ...]
    description: str = ""
    source_precedence: tuple[str, ...] = ()
    relationships: tuple[Relationship, ...] = ()

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def columns(self) -> list[str]:
        return [column(f.name) for f in self.fields]

    @property
    def unique_fields(self) -> list[str]:
        return [f.name for f in self.fields if f.unique]


@dataclass(frozen=True)
class Contract:
    entities: tuple[Entity, ...]
    version: str = "1.0"

    def entity(self, name: str) -> Entity:
        return next(e for e in self.entities if e.name == name)


def _texts(values) -> tuple[str, ...]:
    return tuple(str(v) for v in values or ())


def contract_from_dict(payload: dict) -> Contract:
    """Build and check a contract: names, types, duplicate entities, empty parts."""
    if not isinstance(payload, dict) or not payload.get("entities"):
        raise ContractError("a contract needs at least one entity")
    entities = []
    for item in payload["entities"]:
        name = str(item.get("entity_name") or "")
        if not name.strip():
            raise ContractError("an entity needs a name")
        if not item.get("fields"):
            raise ContractError(f"entity {name} needs at least one field")
        fields = []
        for spec in item["fields"]:
            if not str(spec.get("name") or "").strip():
                raise ContractError(f"entity {name}: a field needs a name")
            data_type = spec.get("data_type", "string")
            if data_type not in TYPES:
                hint = {
                    "email": "; use 'string' and say so in the name",
                    "enum": "; use 'string' with enum_values",
                }.get(str(data_type), "")
                raise ContractError(f"entity {name}, field {spec['name']}: unknown type {data_type}{hint}")
            fields.append(
                Field(
                    name=str(spec["name"]),
                    data_type=data_type,
                    required=bool(spec.get("required", False)),
                    unique=bool(spec.get("unique", False)),
                    aliases=_texts(spec.get("aliases")),
                    enum_values=_texts(spec.get("enum_values")),
                    example_values=_texts(spec.get("example_values")),
                    description=str(spec.get("description") or ""),
                )
            )
        relationships = tuple(
            Relationship(r["field"], r["references_entity"], r["references_field"])
            for r in item.get("relationships") or ()
        )
        entities.append(
            Entity(
                name=name,
                fields=tuple(fields),
                description=str(item.get("description") or ""),
                source_precedence=_texts(item.get("source_precedence")),
                relationships=relationships,
            )
        )
    folded = [e.name.strip().lower() for e in entities]
    repeated = sorted({n for n in folded if folded.count(n) > 1})
    if repeated:
        raise ContractError(f"entity names must differ: {', '.join(repeated)}")
    return Contract(entities=tuple(entities), version=str(payload.get("version", "1.0")))


def load_contract(filename: str, content: str) -> Contract:
    """Contract text in JSON or YAML, told apart by the file suffix."""
    suffix = PurePath(filename).suffix.lower()
    if suffix == ".json":
        try:
            payload = json.loads(content)
        except json.JSONDecodeError as exc:
            raise ContractError(f"contract is not valid JSON near line {exc.lineno}") from exc
    elif suffix in (".yaml", ".yml"):
        import yaml

        try:
            payload = yaml.safe_load(content)
        except yaml.YAMLError as exc:
            raise ContractError("contract is not valid YAML") from exc
    else:
        raise ContractError("a contract is a JSON or YAML file")
    return contract_from_dict(payload)


FIELDS_SCHEMA = T.StructType(
    [
        T.StructField("entity", T.StringType(), False),
        T.StructField("entity_ordinal", T.IntegerType(), False),
        T.StructField("field", T.StringType(), False),
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("data_type", T.StringType(), False),
        T.StructField("required", T.BooleanType(), False),
        T.StructField("is_unique", T.BooleanType(), False),
        T.StructField("aliases", T.ArrayType(T.StringType(), False), False),
        T.StructField("enum_values", T.ArrayType(T.StringType(), False), False),
        T.StructField("description", T.StringType(), False),
    ]
)


def contract_fields(spark: SparkSession, contract: Contract) -> DataFrame:
    """One row per (entity, field). The contract is metadata typed in by a person."""
    rows = [
        (e.name, i, f.name, k, f.data_type, f.required, f.unique, list(f.aliases), list(f.enum_values), f.description)
        for i, e in enumerate(contract.entities)
        for k, f in enumerate(e.fields)
    ]
    return spark.createDataFrame(rows, FIELDS_SCHEMA)


def contract_relationships(spark: SparkSession, contract: Contract) -> DataFrame:
    rows = [
        (e.name, r.field, r.references_entity, r.references_field) for e in contract.entities for r in e.relationships
    ]
    return spark.createDataFrame(
        rows, "entity string, field string, references_entity string, references_field string"
    )
