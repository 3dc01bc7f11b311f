"""All queries over the reference's own operators, with the SQL each is held against."""

from __future__ import annotations

from . import graph, notes, search, usage, writes

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _plans in (usage, search, graph, notes, writes):
    QUERIES.update(_plans.QUERIES)
    ORACLE_SQL.update(_plans.ORACLE_SQL)
