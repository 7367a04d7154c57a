"""Registered queries of the engine and the SQL they are compared with."""

from __future__ import annotations

from . import extracts, files, graph, linking, records, reports, retrieval, selection, views

PARTS = (files, graph, linking, records, reports, retrieval, selection, extracts, views)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
