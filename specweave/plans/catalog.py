"""Queries of the engine and the SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answer_queries, graph_queries, relational_queries, retrieval_queries, source_queries, text_queries, udf_queries

Query = Callable[[SparkSession, str], DataFrame]

_PAIRS: dict[str, tuple[Query, str | None]] = {**relational_queries.PAIRS, **graph_queries.PAIRS, **retrieval_queries.PAIRS, **text_queries.PAIRS, **udf_queries.PAIRS, **answer_queries.PAIRS, **source_queries.PAIRS}
QUERIES: dict[str, Query] = {name: pair[0] for name, pair in _PAIRS.items()}
ORACLE_SQL: dict[str, str] = {name: pair[1] for name, pair in _PAIRS.items() if pair[1]}
