"""All queries of the training-data operators, and SQL with the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from neume.llm import decontam, language, licenses, line_dedup, mixing, near_dedup, pii, quality, toxicity, warc

MODULES = [line_dedup, toxicity, licenses, warc, decontam, quality, pii, mixing, near_dedup, language]


def queries() -> dict[str, Callable]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
