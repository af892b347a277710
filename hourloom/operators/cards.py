"""Project board: cards and status counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.plans.periods import in_period
from hourloom.schema import ARCHIVED, CURRENT, Tables

_CARD = ["id", "name", "square", "count_users", "sum_hours", "is_done", "level", "last_act"]


def project_cards(
    t: Tables, relevant: str | None = None, year: int | None = None, scoped: bool = False
) -> DataFrame:
    """One card per project, people and hours on it, busiest levels first.

    `relevant` is CURRENT, ARCHIVED or None for both. `year` keeps the projects with entries
    in that year; their totals stay all-time unless `scoped`.

    One scan gives totals and the year test. Distinct people come from a first sum per
    project and user, so a project with a third of all entries is combined before the
    shuffle and needs no distinct aggregate.
    """
    in_year = in_period(F.col("dateStamp"), year)
    entries = t.fact.select("projectId", "userId", "dateStamp", "hours")
    if in_year is None:
        in_year = F.lit(True)
    elif scoped:
        entries = entries.filter(in_year)
    per_user = entries.groupBy("projectId", "userId").agg(
        F.sum(F.col("hours").cast("int")).alias("_hours"),
        F.max("dateStamp").alias("_last"),
        F.max(in_year).alias("_in_year"),
    )
    per_project = per_user.groupBy("projectId").agg(
        F.count("userId").alias("count_users"),
        F.sum("_hours").alias("sum_hours"),
        F.max("_last").alias("last_act"),
        F.max("_in_year").alias("_in_year"),
    )
    cards = t.project.filter(_relevance(relevant)).join(
        per_project, F.col("id") == F.col("projectId"), "left"
    )
    if year is not None:
        cards = cards.filter(F.col("_in_year"))
    return cards.withColumn("is_done", F.col("isDone")).select(*_CARD).orderBy("is_done", F.desc("level"), F.desc("last_act"), "id")


def yearly_summary(fact: DataFrame) -> DataFrame:
    """(projectId, year, bucket, people, hours, last): per project and year the hours, the last
    day, and the people as bits that merge. To be stored; cards of any years come from it
    without the log. A row's bits cover 64 neighbouring user ids, so a row is small whether few
    or many people worked on a project, and sums stay in fixed-width hash tables."""
    return fact.groupBy(
        "projectId", F.year("dateStamp").alias("year"), F.shiftright("userId", 6).alias("bucket")
    ).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(userId & 63 AS INT))")).alias("people"),
        F.sum(F.col("hours").cast("int")).alias("hours"),
        F.max("dateStamp").alias("last"),
    )


def cards_of_years(
    t: Tables, summary: DataFrame, first: int, last: int, relevant: str | None = None
) -> DataFrame:
    """The cards of the projects with entries in the years first..last, people, hours and last
    day in these years only, from a stored `yearly_summary`. People who worked in several of
    the years count once."""
    merged = (
        summary.filter(F.col("year").between(first, last))
        .groupBy("projectId", "bucket")
        .agg(
            F.bit_or("people").alias("people"),
            F.sum("hours").alias("hours"),
            F.max("last").alias("last"),
        )
        .groupBy("projectId")
        .agg(
            F.sum(F.coalesce(F.bit_count("people"), F.lit(0))).alias("count_users"),
            F.sum("hours").alias("sum_hours"),
            F.max("last").alias("last_act"),
        )
    )
    cards = t.project.filter(_relevance(relevant)).join(merged, F.col("id") == F.col("projectId"))
    return cards.withColumn("is_done", F.col("isDone")).select(*_CARD).orderBy("is_done", F.desc("level"), F.desc("last_act"), "id")


def _relevance(relevant: str | None) -> Column:
    if relevant == ARCHIVED:
        return F.col("isDone") != 0
    if relevant == CURRENT:
        return F.col("isDone") != 1
    if relevant is None:
        return F.lit(True)
    raise ValueError(f"relevant must be {CURRENT!r}, {ARCHIVED!r} or None, got {relevant!r}")


def count_projects(t: Tables, excluded: int = 1) -> DataFrame:
    """Number of projects whose flag is not `excluded`: 1 counts the current ones."""
    return t.project.filter(F.col("isDone") != excluded).agg(F.count(F.lit(1)).alias("n"))


def status_counts(t: Tables) -> DataFrame:
    """Number of projects per flag value."""
    return t.project.groupBy(F.col("isDone").alias("is_done")).agg(F.count(F.lit(1)).alias("n"))


def user_status_counts(t: Tables) -> DataFrame:
    """Distinct projects each user has worked on, per flag; users without entries are absent."""
    worked = t.fact.select("userId", "projectId").distinct()
    return (
        worked.join(t.project.select("id", "isDone"), F.col("projectId") == F.col("id"))
        .groupBy(F.col("userId").alias("user_id"), F.col("isDone").alias("is_done"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def count_projects_of(t: Tables, user_id: int, excluded: int = 1) -> DataFrame:
    """One row: distinct projects of one user whose flag is not `excluded`, 0 when none."""
    worked = t.fact.filter(F.col("userId") == user_id).select("projectId").distinct()
    wanted = t.project.filter(F.col("isDone") != excluded)
    return worked.join(wanted, worked.projectId == wanted.id, "left_semi").agg(
        F.count(F.lit(1)).alias("n")
    )

