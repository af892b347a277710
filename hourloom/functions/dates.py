"""Date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names by number.
MONTH_NAMES = {
    1: "Январь",
    2: "Февраль",
    3: "Март",
    4: "Апрель",
    5: "Май",
    6: "Июнь",
    7: "Июль",
    8: "Август",
    9: "Сентябрь",
    10: "Октябрь",
    11: "Ноябрь",
    12: "Декабрь",
}


def month_name(month: Column) -> Column:
    """Name of a month number, empty text for anything else."""
    names = F.create_map(*[F.lit(x) for pair in MONTH_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, month), F.lit(""))


def two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def days_in_month(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def is_weekend(day: Column) -> Column:
    return F.weekday(day).isin(5, 6)


def date_of(year: Column, month: Column, day: Column) -> Column:
    """Date from its parts; NULL when there is no such day."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), two_digits(month), two_digits(day))
    return F.try_to_date(text, "yyyy-MM-dd")
