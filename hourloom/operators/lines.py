"""Line series of the charts: hours per day or month, with breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hourloom.plans.periods import check_period, in_period
from hourloom.plans.predicates import all_of
from hourloom.schema import Tables


def _series(t: Tables, year: int, month: int | None, only: Column | None) -> DataFrame:
    """(projectId, userId, x, hours); x is the day when a month is given, else the month."""
    check_period(year, month)
    x = F.month("dateStamp") if month is None else F.dayofmonth("dateStamp")
    return (
        t.fact.filter(all_of([in_period(F.col("dateStamp"), year, month), only]))
        .groupBy("projectId", "userId", x.alias("x"))
        .agg(F.sum(F.col("hours").cast("int")).alias("hours"))
    )


def project_lines(
    t: Tables, year: int, month: int | None = None, project_id: int | None = None
) -> DataFrame:
    """One line per person for each project (or for one). Series are told apart by user id."""
    only = None if project_id is None else F.col("projectId") == project_id
    people = t.user.select("id", F.col("name").alias("user"), "color")
    return (
        _series(t, year, month, only)
        .join(people, F.col("userId") == F.col("id"))
        .select(
            F.col("projectId").alias("project_id"),
            F.col("userId").alias("user_id"),
            "user",
            "color",
            "x",
            "hours",
        )
    )


def user_lines(
    t: Tables, year: int, month: int | None = None, user_id: int | None = None
) -> DataFrame:
    """One line per project for each person (or for one)."""
    only = None if user_id is None else F.col("userId") == user_id
    projects = t.project.select("id", F.col("name").alias("project"))
    return (
        _series(t, year, month, only)
        .join(projects, F.col("projectId") == F.col("id"))
        .select(
            F.col("userId").alias("user_id"),
            F.col("projectId").alias("project_id"),
            "project",
            "x",
            "hours",
        )
    )


def with_breaks(lines: DataFrame, series: list[str]) -> DataFrame:
    """Points of each line in order, with an empty point where more than one step is missing.

    A series has at most 31 points, so its window stays small.
    """
    ordered = W.partitionBy(*series).orderBy("x")
    gap = F.coalesce(F.lead("x").over(ordered) - F.col("x") > 1, F.lit(False))
    so_far = ordered.rowsBetween(W.unboundedPreceding, -1)
    point = F.struct(F.col("x").alias("x"), F.col("hours").alias("hours"), F.lit(0).alias("step"))
    empty = F.struct(
        F.lit(None).cast("int").alias("x"), F.lit(None).cast("bigint").alias("hours"), F.lit(1).alias("step")
    )
    return (
        lines.withColumn("_gap", gap)
        .withColumn(
            "_seq",
            F.row_number().over(ordered)
            + F.coalesce(F.sum(F.col("_gap").cast("int")).over(so_far), F.lit(0)),
        )
        .withColumn("_p", F.explode(F.when(F.col("_gap"), F.array(point, empty)).otherwise(F.array(point))))
        .select(
            *series,
            (F.col("_seq") + F.col("_p.step")).cast("int").alias("seq"),
            F.col("_p.x").alias("x"),
            F.col("_p.hours").alias("hours"),
        )
    )
