"""Registered queries of the catalog and analytics operators."""

from __future__ import annotations

from stallgrid.plans import analytics_queries, catalog_queries, ingest_queries, stream_queries

_PARTS = (analytics_queries, catalog_queries, ingest_queries, stream_queries)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
