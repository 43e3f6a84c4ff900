"""Queries over the driver's tables that apply the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitrine.plans import catalogue_queries, found_queries, page_queries, record_queries, served_queries, store_queries, stream_queries, written_queries
from vitrine.workers import let_workers_import


def _run(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        let_workers_import(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = {**catalogue_queries.QUERIES, **record_queries.QUERIES, **stream_queries.QUERIES, **served_queries.QUERIES, **page_queries.QUERIES, **written_queries.QUERIES, **store_queries.QUERIES, **found_queries.QUERIES}
    return {k: _run(f) for k, f in every.items()}


def oracle_sql() -> dict[str, str]:
    return {**catalogue_queries.SQL, **record_queries.SQL, **stream_queries.SQL, **served_queries.SQL, **page_queries.SQL, **written_queries.SQL, **store_queries.SQL, **found_queries.SQL}
