"""The registered queries and their SQL, gathered from the modules of this folder."""

from __future__ import annotations

from skein.plans import data_queries, graph_queries

MODULES = [graph_queries, data_queries]


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
