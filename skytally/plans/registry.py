"""Registered queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from . import aggregates, files, filters, joins, more, projections, windows

MODULES = (projections, filters, joins, aggregates, windows, more, files)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
