"""The operators applied to the driver's tables, each with a SQL counterpart."""

from graphloom.harness import (  # noqa: F401  (importing registers the queries)
    build_queries,
    flagship,
    graph_queries,
    model_queries,
    search_queries,
    storage_queries,
    text_queries,
    version_queries,
)
from graphloom.harness.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
