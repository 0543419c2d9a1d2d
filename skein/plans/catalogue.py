"""All queries over the operators of this engine, with the same results as SQL over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import curation_queries, event_queries, fleet_queries, hazard_queries, headline_queries, label_queries, news_queries, place_queries, record_queries, signal_queries, stream_queries, view_queries

_MODULES = (event_queries, place_queries, record_queries, signal_queries, news_queries, fleet_queries, hazard_queries, curation_queries,
    label_queries, headline_queries, view_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
