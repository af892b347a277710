"""Year and month predicates written as date ranges, so they reach the parquet scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_period(year: int | None, month: int | None) -> None:
    if month is not None and not 1 <= month <= 12:
        raise ValueError(f"month must be 1..12 or None, got {month!r}")
    if year is not None and not 1 <= year <= 9998:
        raise ValueError(f"year must be 1..9998 or None, got {year!r}")


def bounds(year: int, month: int | None = None) -> tuple[dt.date, dt.date]:
    """First day of the period and first day after it."""
    check_period(year, month)
    if month is None:
        return dt.date(year, 1, 1), dt.date(year + 1, 1, 1)
    after = (year, month + 1) if month < 12 else (year + 1, 1)
    return dt.date(year, month, 1), dt.date(*after, 1)


def in_period(day: Column, year: int | None = None, month: int | None = None) -> Column | None:
    """Predicate for a year, a month of a year, or a month of any year; None for no limit."""
    check_period(year, month)
    if year is not None:
        first, after = bounds(year, month)
        return (day >= F.lit(first)) & (day < F.lit(after))
    if month is not None:
        return F.month(day) == month
    return None
