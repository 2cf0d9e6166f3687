"""Queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from foliant.plans import derived_queries, flow_queries, table_queries, text_queries

QUERIES = {**text_queries.QUERIES, **table_queries.QUERIES, **derived_queries.QUERIES, **flow_queries.QUERIES}
SQL = {**text_queries.SQL, **table_queries.SQL, **derived_queries.SQL, **flow_queries.SQL}
FLAGSHIP = text_queries.QUERIES["line_tokens"]
