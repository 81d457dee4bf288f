"""The queries that the driver runs, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noticeflow.plans import evidence_queries, layout_queries, linkage_queries, report_queries, result_queries, run_queries, state_queries, text_queries

_ALL = {**state_queries.QUERIES, **report_queries.QUERIES, **text_queries.QUERIES, **result_queries.QUERIES, **layout_queries.QUERIES, **linkage_queries.QUERIES, **evidence_queries.QUERIES, **run_queries.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
