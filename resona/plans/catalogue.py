"""The registered queries and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graph_queries, retrieval_queries, state_queries, structure_queries, text_queries, vector_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _family in (vector_queries, text_queries, retrieval_queries, state_queries, graph_queries, structure_queries):
    QUERIES |= _family.QUERIES
    ORACLE_SQL |= _family.SQL
