"""Pages of a large table in a total order, newest day first."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest_first(day: str, ties: tuple[str, ...]) -> list[Column]:
    return [F.desc(day), *[F.asc(c) for c in ties]]


def first_rows(rows: DataFrame, day: str, ties: tuple[str, ...], size: int) -> DataFrame:
    """The first `size` rows, newest day first; each task keeps so many."""
    return rows.orderBy(*newest_first(day, ties)).limit(size)


def page_days(rows: DataFrame, day: str, offset: int, size: int) -> DataFrame:
    """(day, _before): the days that hold rows `offset .. offset + size`, newest first, and how
    many rows come before each; at most `size` rows.

    Rows are counted per day, and one running sum goes over the calendar's days. No row is
    sorted for it, however deep the page.
    """
    counts = rows.groupBy(F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = counts.agg(F.sort_array(F.collect_list(F.struct("day", "n")), asc=False).alias("all"))
    kind = rows.schema[day].dataType.simpleString()
    start = F.struct(
        F.lit(0).cast("long").alias("total"),
        F.array().cast(f"array<struct<day:{kind},_before:bigint>>").alias("days"),
    )

    def onto(state: Column, d: Column) -> Column:
        after = state["total"] + d["n"]
        hit = (state["total"] < offset + size) & (after > offset)
        found = F.array_append(state["days"], F.struct(d["day"].alias("day"), state["total"].alias("_before")))
        return F.struct(after.alias("total"), F.when(hit, found).otherwise(state["days"]).alias("days"))

    state = F.aggregate("all", start, onto)
    return days.select(F.inline(state["days"])).withColumnRenamed("day", day)


def placed(rows: DataFrame, day: str, ties: tuple[str, ...], offset: int, size: int) -> DataFrame:
    """Rows `offset .. offset + size` among rows of their days that carry `_before`."""
    inside = W.partitionBy(day).orderBy(*ties)
    place = F.col("_before") + F.row_number().over(inside)
    return (
        rows.withColumn("_place", place)
        .filter((F.col("_place") > offset) & (F.col("_place") <= offset + size))
        .drop("_before", "_place")
    )


def after_key(day: str, ties: tuple[str, ...], last: dict) -> Column:
    """Rows that follow the row with the values `last` in the page order."""
    columns = [day, *ties]
    steps = []
    for i, c in enumerate(columns):
        equal = [F.col(p) == F.lit(last[p]) for p in columns[:i]]
        beyond = F.col(c) < F.lit(last[c]) if c == day else F.col(c) > F.lit(last[c])
        steps.append(reduce(and_, equal, F.lit(True)) & beyond)
    # The plain day bound is implied; stated on its own it reaches the scan.
    return (F.col(day) <= F.lit(last[day])) & reduce(lambda a, b: a | b, steps)
