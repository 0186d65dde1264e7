"""All queries of the library outside the corpus operators."""

from __future__ import annotations

from . import queries_directory, queries_graph, queries_marts, queries_records

MODULES = [queries_graph, queries_marts, queries_directory, queries_records]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
