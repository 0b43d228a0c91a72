"""Registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparvox.plans import evaluation, operations  # noqa: F401  operations adds its queries to evaluation's


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(evaluation.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(evaluation.SQL)
