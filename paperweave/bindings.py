"""Queries over the driver's tables, one for each operator, with their SQL where it can express them."""

from __future__ import annotations

from .plans import change_queries, collection, graph_build, layout_queries, library_queries, network_queries, record_queries, report_queries, statement_queries

_ALL = library_queries.QUERIES | network_queries.QUERIES | change_queries.QUERIES | record_queries.QUERIES | collection.QUERIES | graph_build.QUERIES | report_queries.QUERIES | statement_queries.QUERIES | layout_queries.QUERIES


def queries() -> dict:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
