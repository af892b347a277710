"""Shown column headers."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Headers of the work log, the user directory and the project directory.
LOG_HEADERS = {
    "year": "ГОД",
    "month": "ММ",
    "day": "ДД",
    "user": "СОТРУДНИК",
    "project": "ПРОЕКТ",
    "stage": "ЭТАП",
    "square": "м²",
    "hours": "ЧАСЫ",
}
USER_HEADERS = {"name": "ИМЯ", "login": "ЛОГИН", "color": "ЦВЕТ", "admin": "АДМИН", "status": "СТАТУС"}
PROJECT_HEADERS = {"name": "НАЗВАНИЕ", "square": "M²", "startdate": "СТАРТ", "status": "СТАТУС"}


def with_headers(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Rename the columns that have a header; others keep their names."""
    return df.withColumnsRenamed({c: h for c, h in headers.items() if c in df.columns})
