"""All registered queries of the engine with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import corridor_queries, exchange_queries, graph_queries, polyline_queries, spatial_queries

_MODULES = (polyline_queries, spatial_queries, corridor_queries, graph_queries, exchange_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
