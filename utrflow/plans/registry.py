"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from utrflow.plans import library_queries, model_queries, queries

QUERIES = queries.QUERIES | model_queries.QUERIES | library_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | model_queries.ORACLE_SQL | library_queries.ORACLE_SQL
