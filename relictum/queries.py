"""Registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relictum.catalog import captures, control, pages
from relictum.catalog.registry import QUERIES, SQL

__all__ = ["captures", "control", "flagship", "oracle_sql", "pages", "queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the share of their text that is their own, as a signal of fidelity."""
    return QUERIES["boilerplate"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
