"""All queries by name, and their SQL."""

from __future__ import annotations

from lexloom.plans import index_queries, pipeline_queries, table_queries, text_queries, vector_queries

_PARTS = (index_queries, text_queries, vector_queries, table_queries, pipeline_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
flagship = index_queries.flagship
