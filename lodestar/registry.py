"""All queries of the library and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans import queries_daily, queries_data, queries_more, queries_records

MODULES = (queries_daily, queries_data, queries_more, queries_records)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum ranking: bars, windows, percentiles, the best twenty."""
    return queries_daily.QUERIES["k1_screen"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.ORACLES.items()}
