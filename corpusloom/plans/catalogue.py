"""Queries over the test tables, one or more for each operator, each with its SQL twin where SQL can say the same."""

from __future__ import annotations

from corpusloom.plans import columns, drivers, gold, history, ranking, texts, web

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (texts, ranking, history, gold, web, columns, drivers):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
