"""All queries over the shared test tables, each with the DuckDB statement it is compared with."""

from __future__ import annotations

from orarium.plans import display_queries, entity_queries, interval_queries, page_queries, roster_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for module in (interval_queries, entity_queries, display_queries, roster_queries, page_queries):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
