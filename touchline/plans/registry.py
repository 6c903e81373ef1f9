"""All queries over the reference tables, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under ``name``, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


for _module in ("relational", "timeline", "market", "evaluation", "ratings", "text", "identity", "integrity", "live", "extended", "models", "scenarios", "durable", "decisions", "monitoring", "records"):
    import_module(f"touchline.plans.{_module}")
