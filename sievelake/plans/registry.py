"""Registered queries of the engine and the SQL that gives the same results."""

from __future__ import annotations

from . import corpus_queries, experiment_queries, memory_queries

MODULES = (experiment_queries, corpus_queries, memory_queries)


def queries() -> dict:
    found: dict = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= module.SQL
    return found
