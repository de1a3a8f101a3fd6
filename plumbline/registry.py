"""All queries of the library, by name, and their SQL."""

from __future__ import annotations

from plumbline.operators import assembly_catalogue as assembly
from plumbline.operators import catalogue as operations
from plumbline.plans import catalogue

_MODULES = (catalogue, operations, assembly)


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
