"""All queries over the test tables, with their SQL oracles, by operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vacantia.plans import dedup_queries, extract_queries, ingest_queries, matching_queries, normalize_queries, quality_queries, report_queries, stream_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [dedup_queries, extract_queries, ingest_queries, matching_queries, normalize_queries, quality_queries, report_queries, stream_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching_queries.flagship(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
