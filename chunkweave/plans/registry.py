"""All queries over the project's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from chunkweave.plans import corpus_queries, graph_queries, retrieval_queries, text_queries

FLAGSHIP = "build_neighbors"
_MODULES = (text_queries, corpus_queries, graph_queries, retrieval_queries)


def queries() -> dict[str, Callable]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
