"""Named queries with their SQL counterparts."""

from __future__ import annotations

from docloom.plans import layout_queries, office_queries, region_queries, source_queries, table_queries, text_queries

_PARTS = (text_queries, layout_queries, office_queries, region_queries, table_queries, source_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
