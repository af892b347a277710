"""Pivots with a known set of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_values(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct values to pivot on: the columns to be, so callers narrow `df` to one
    project or one person first."""
    return sorted(row[0] for row in df.select(column).distinct().collect())


def pivot_sum(df: DataFrame, index: list[str], column: str, value: str, values: list[str]) -> DataFrame:
    """Sum of `value` per index row and pivot column, 0 where there is none."""
    wide = df.groupBy(*index).pivot(column, values).agg(F.sum(value))
    return wide.fillna(0, subset=values) if values else wide
