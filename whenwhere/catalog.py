"""All registered queries of the reference's operators and their DuckDB SQL."""

from __future__ import annotations

from .plans import listing_queries, source_queries, view_queries

QUERIES = view_queries.QUERIES | listing_queries.QUERIES | source_queries.QUERIES
ORACLE = view_queries.ORACLE | listing_queries.ORACLE | source_queries.ORACLE
flagship = view_queries.q_flagship
