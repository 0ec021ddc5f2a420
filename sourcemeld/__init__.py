"""Spark-native reconciliation of messy tables into a declared target contract."""

from sourcemeld.contract import Contract, Entity, Field, Relationship, load_contract

__all__ = ["Contract", "Entity", "Field", "Relationship", "load_contract"]
