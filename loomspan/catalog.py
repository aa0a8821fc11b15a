"""All registered queries of the library's own operators, with the SQL they equal."""

from __future__ import annotations

from .plans import check_queries, dedup_queries, graph_queries, record_queries, retrieval_queries, source_queries, state_queries, unit_queries

_PARTS = (dedup_queries, retrieval_queries, state_queries, graph_queries, source_queries, record_queries, unit_queries, check_queries)
QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
FLAGSHIP = "duplicate_leaders"
