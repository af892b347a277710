"""Text columns: first names, headers, labels, comparison under a collation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Case and accent blind comparison, as the source database compares text.
NAME_COLLATION = "UNICODE_CI_AI"
# Case blind only.
LOGIN_COLLATION = "UTF8_LCASE"

# Flag labels.
YES, NO = "Да", "Нет"
ACTIVE, INACTIVE = "Актуальный", "Не актуальный"


def first_name(name: Column) -> Column:
    """Text before the first space; empty when there is no space."""
    head = F.substring_index(name, " ", 1)
    return F.when(F.instr(name, " ") > 0, head).when(name.isNotNull(), F.lit(""))


def header(name: Column) -> Column:
    """Text before the first space; the whole text when there is no space."""
    return F.substring_index(name, " ", 1)


def short_header(name: Column, width: int = 30) -> Column:
    return F.substring(name, 1, width)


def same_name(left: Column, right: Column) -> Column:
    return F.collate(left, NAME_COLLATION) == F.collate(right, NAME_COLLATION)


def same_login(left: Column, right: Column) -> Column:
    return F.collate(left, LOGIN_COLLATION) == F.collate(right, LOGIN_COLLATION)


def yes_no(flag: Column) -> Column:
    return F.when(flag == 1, F.lit(YES)).otherwise(F.lit(NO))


def status_label(flag: Column, active_value: int) -> Column:
    return F.when(flag == active_value, F.lit(ACTIVE)).otherwise(F.lit(INACTIVE))
