"""Queries of the corpus subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from flowloom.llm import text_queries, traffic_queries

_MODULES = (traffic_queries, text_queries)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
