"""Registry of the engine's own queries and of their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from . import call_queries, cypher_queries, detail_queries, fact_queries, graph_operator_queries, graph_queries, import_queries, more_queries, report_queries, scope_queries, search_queries

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
for _module in (search_queries, graph_queries, report_queries, more_queries, cypher_queries, graph_operator_queries, fact_queries, call_queries, import_queries, scope_queries, detail_queries):
    QUERIES.update(_module.REGISTRY.queries)
    ORACLE.update(_module.REGISTRY.oracle)
