"""Month calendar: entries, legend, day rows, day-to-day continuity, the hour grid."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hourloom.functions.colours import to_hex
from hourloom.functions.dates import days_in_month, is_weekend, month_name, month_start
from hourloom.plans.joins import listed
from hourloom.plans.periods import bounds, in_period
from hourloom.plans.predicates import all_of
from hourloom.schema import GRID_HOURS, STAGE_NAMES, Tables


def _entries(
    t: Tables, year: int | None, month: int | None, project_id: int | None
) -> DataFrame:
    only = None if project_id is None else F.col("projectId") == project_id
    return t.fact.filter(all_of([in_period(F.col("dateStamp"), year, month), only]))


def calendar_detail(
    t: Tables,
    year: int | None = None,
    month: int | None = None,
    project_id: int | None = None,
    stage: str | None = None,
) -> DataFrame:
    """Entries with person, colour, day, hours and stage.

    One project and month come sorted by stage, user and day, as a calendar reads them; the
    form for everything is left unsorted, since sorting all entries would shuffle them for
    an order no reader needs.
    """
    people = t.user.select(F.col("id").alias("_user"), F.col("color").alias("_color"))
    stages = t.stage.select(F.col("id").alias("_stage"), F.col("name").alias("stage"))
    if stage is not None:
        stages = stages.filter(F.col("stage") == stage)
    rows = (
        _entries(t, year, month, project_id)
        .join(listed(stages), F.col("stageId") == F.col("_stage"))
        .join(people, F.col("userId") == F.col("_user"))
    )
    if project_id is not None and year is not None and month is not None:
        rows = rows.orderBy("stageId", "userId", "dateStamp", *t.tie_keys)
    return rows.select(
        F.col("projectId").alias("project_id"),
        F.year("dateStamp").alias("year"),
        F.month("dateStamp").alias("month"),
        F.dayofmonth("dateStamp").alias("day"),
        F.col("stageId").alias("stage_id"),
        "stage",
        F.col("userId").alias("user_id"),
        to_hex(F.col("_color")).alias("color"),
        "hours",
    )


def calendar_legend(
    t: Tables,
    year: int | None = None,
    month: int | None = None,
    project_id: int | None = None,
) -> DataFrame:
    """People with entries per project and month: (project_id, year, month, user_id, name, color)."""
    present = (
        _entries(t, year, month, project_id)
        .select(
            "projectId",
            "userId",
            F.year("dateStamp").alias("year"),
            F.month("dateStamp").alias("month"),
        )
        .distinct()
    )
    people = t.user.select("id", "name", "color")
    return present.join(people, F.col("userId") == F.col("id")).select(
        F.col("projectId").alias("project_id"),
        "year",
        "month",
        F.col("userId").alias("user_id"),
        "name",
        to_hex(F.col("color")).alias("color"),
    )


# ---------------------------------------------------------------- days


def _day_columns(today: dt.date) -> list[Column]:
    date = F.col("date")
    return [
        date,
        F.year(date).alias("year"),
        F.month(date).alias("month"),
        F.dayofmonth(date).alias("day"),
        month_name(F.month(date)).alias("month_name"),
        days_in_month(date).alias("num_days"),
        is_weekend(date).cast("int").alias("is_weekend"),
        (date == F.lit(today)).cast("int").alias("is_today"),
    ]


def date_dimension(t: Tables, today: dt.date) -> DataFrame:
    """Every day from the first month with entries to the end of the last one."""
    span = t.fact.agg(F.min("dateStamp").alias("a"), F.max("dateStamp").alias("b"))
    days = span.filter(F.col("a").isNotNull()).select(
        F.explode(F.sequence(month_start(F.col("a")), F.last_day("b"))).alias("date")
    )
    return days.select(*_day_columns(today))


def _project_months(entries: DataFrame) -> DataFrame:
    return entries.select("projectId", month_start(F.col("dateStamp")).alias("month_start")).distinct()


def project_days(
    t: Tables, today: dt.date, year: int | None = None, month: int | None = None
) -> DataFrame:
    """The day row of the calendar for each project and month with entries."""
    months = _project_months(_entries(t, year, month, None))
    days = months.select(
        F.col("projectId").alias("project_id"),
        F.explode(F.sequence("month_start", F.last_day("month_start"))).alias("date"),
    )
    return days.select("project_id", *_day_columns(today))


# ---------------------------------------------------------------- continuity and grid


def _with_neighbours(year: int | None, month: int) -> Column:
    """The period and one day on either side."""
    date = F.col("dateStamp")
    if year is None:
        near = [in_period(F.date_add(date, step), None, month) for step in (-1, 0, 1)]
        return near[0] | near[1] | near[2]
    first, after = bounds(year, month)
    one = dt.timedelta(days=1)
    return (date >= F.lit(first - one)) & (date < F.lit(after + one))


def contiguity(
    t: Tables,
    year: int | None = None,
    month: int | None = None,
    project_id: int | None = None,
) -> DataFrame:
    """(project_id, stage_id, date, user_id, hours, entries, left_f, right_f).

    A flag is 1 when the same person has, on the same project and stage, an entry of at
    least these hours on the day before (left) or after (right), across month ends too.
    Equal entries of one person and day are one row with their number in `entries`; that
    first sum keeps the window below to a few rows per calendar day.
    """
    only = None if project_id is None else F.col("projectId") == project_id
    day = in_period(F.col("dateStamp"), year, month)
    wider = None
    if day is not None:
        # Neighbours just outside the period decide the flags at its ends.
        wider = _with_neighbours(year, month)
    merged = (
        t.fact.filter(all_of([only, wider]))
        .groupBy("projectId", "stageId", "dateStamp", "userId", "hours")
        .agg(F.count(F.lit(1)).alias("entries"))
    )
    days = W.partitionBy("userId", "projectId", "stageId").orderBy(F.unix_date("dateStamp"))
    before = F.max("hours").over(days.rangeBetween(-1, -1))
    after = F.max("hours").over(days.rangeBetween(1, 1))
    flagged = merged.withColumns(
        {
            "left_f": F.coalesce(before >= F.col("hours"), F.lit(False)).cast("int"),
            "right_f": F.coalesce(after >= F.col("hours"), F.lit(False)).cast("int"),
        }
    )
    if day is not None:
        flagged = flagged.filter(day)
    return flagged.select(
        F.col("projectId").alias("project_id"),
        F.col("stageId").alias("stage_id"),
        F.col("dateStamp").alias("date"),
        F.col("userId").alias("user_id"),
        "hours",
        "entries",
        "left_f",
        "right_f",
    )


def _cells(entries: DataFrame) -> DataFrame:
    """(project_id, stage_id, date, people): who may show up in a day's twelve hours.

    Hour h shows the first two entries with at least h hours, in order of user id (longer
    entry first for one person). Those are among the first two of every exact length, so
    two per length suffice: at most 26 entries reach a cell however many it holds, and the
    limit already applies before the shuffle. Lengths beyond the grid count as one.
    """
    length = F.least(F.col("hours"), F.lit(GRID_HOURS + 1))
    first = W.partitionBy("project_id", "stage_id", "date", "_length").orderBy(
        "user_id", F.desc("hours")
    )
    kept = (
        entries.withColumn("_length", length)
        .withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") <= 2)
    )
    person = F.struct(
        F.col("user_id"),
        (-F.col("hours")).alias("shortness"),
        F.col("hours"),
        F.col("entries"),
        F.col("left_f"),
        F.col("right_f"),
    )
    return (
        kept.groupBy("project_id", "stage_id", "date")
        .agg(F.array_sort(F.collect_list(person)).alias("people"))
        .withColumn(
            "people",
            F.flatten(
                F.transform(
                    "people", lambda p: F.array_repeat(p, F.least(p["entries"], F.lit(2)).cast("int"))
                )
            ),
        )
    )


def calendar_grid(
    t: Tables,
    year: int | None = None,
    month: int | None = None,
    project_id: int | None = None,
    stage: str | None = None,
) -> DataFrame:
    """The hour grid of each project and month with entries.

    (project_id, year, month, stage_id, stage, day, hour, n, u1, u2, is_top, left_f,
    right_f) for every day of the month, listed stage and hour 1..12. An entry covers hour h
    when h <= its hours; n is 0, 1, or 2 for two and more. A cell is a top when h equals the
    hours of all people shown in it; flags are set on tops with a single entry.
    """
    cells = _cells(contiguity(t, year, month, project_id))
    months = _project_months(_entries(t, year, month, project_id))
    listed = [(i, n) for i, n in enumerate(STAGE_NAMES, start=1) if stage in (None, n)]
    stages = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in listed])
    frame = (
        months.select(
            F.col("projectId").alias("project_id"),
            F.explode(F.sequence("month_start", F.last_day("month_start"))).alias("date"),
        )
        .withColumn("_stage", F.explode(stages))
        .select(
            "project_id",
            "date",
            F.col("_stage.id").alias("stage_id"),
            F.col("_stage.name").alias("stage"),
        )
    )
    filled = frame.join(cells, ["project_id", "stage_id", "date"], "left")
    hour = F.col("hour")
    shown = F.slice(F.filter("people", lambda p: p["hours"] >= hour), 1, 2)
    one, two = F.get("_shown", F.lit(0)), F.get("_shown", F.lit(1))
    n = F.coalesce(F.size("_shown"), F.lit(0))
    top = F.coalesce(
        (one["hours"] == hour) & (two.isNull() | (two["hours"] == hour)), F.lit(False)
    )
    single_top = F.col("is_top").cast("boolean") & (F.col("n") == 1)
    return (
        filled.withColumn("hour", F.explode(F.sequence(F.lit(1), F.lit(GRID_HOURS))))
        .withColumn("_shown", F.when(F.col("people").isNotNull(), shown))
        .withColumns(
            {
                "n": F.when(F.col("_shown").isNull(), 0).otherwise(n),
                "u1": one["user_id"],
                "u2": two["user_id"],
                "is_top": top.cast("int"),
            }
        )
        .select(
            "project_id",
            F.year("date").alias("year"),
            F.month("date").alias("month"),
            "stage_id",
            "stage",
            F.dayofmonth("date").alias("day"),
            "hour",
            "n",
            "u1",
            "u2",
            "is_top",
            F.when(single_top, one["left_f"]).otherwise(0).alias("left_f"),
            F.when(single_top, one["right_f"]).otherwise(0).alias("right_f"),
        )
    )
