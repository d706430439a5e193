"""The library's queries on the provided tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.plans import queries_activity, queries_context, queries_ledger, queries_local, queries_more, queries_rank, queries_rules, queries_stream, queries_tables, queries_text, queries_trial

MODULES = (queries_activity, queries_local, queries_rules, queries_rank, queries_tables, queries_text, queries_more, queries_ledger, queries_context, queries_trial, queries_stream)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
