"""All core queries and their SQL, by name."""

from __future__ import annotations

from corpusloom.plans import dashboard, incremental, lifecycle, pipeline, retrieval, streams
from corpusloom.plans.sqltext import floored

MODULES = [incremental, dashboard, pipeline, lifecycle, retrieval, streams]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.queries().items()}


def oracle_sql() -> dict:
    return {name: floored(sql) for module in MODULES for name, sql in module.oracle_sql().items()}
