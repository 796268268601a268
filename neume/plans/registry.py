"""All queries over the star-schema tables, and SQL with the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from neume.plans import aggregate_queries, chart_queries, decision_queries, fold_queries, music_queries, page_queries, reading_queries, sequence_queries, spatial_queries

MODULES = [spatial_queries, sequence_queries, aggregate_queries, fold_queries, music_queries, page_queries, chart_queries, decision_queries, reading_queries]


def queries() -> dict[str, Callable]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
