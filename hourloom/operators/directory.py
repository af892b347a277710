"""Directories, lookups, deadlines and series colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourloom.functions.colours import FALLBACK_HEX, NO_LOGIN_COLOUR, PALETTE, to_css, to_hex
from hourloom.functions.text import first_name, same_login, same_name, status_label, yes_no
from hourloom.plans.periods import in_period
from hourloom.plans.predicates import all_of
from hourloom.schema import STAGE_NAMES, Tables


def stage_deadlines(t: Tables) -> DataFrame:
    """Six rows per project; a stage without a stored deadline has none, and shifts no other."""
    listed = F.array(
        *[
            F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"))
            for i, n in enumerate(STAGE_NAMES, start=1)
        ]
    )
    wanted = t.project.select(F.col("id").alias("projectId"), F.explode(listed).alias("_s")).select(
        "projectId", F.col("_s.id").alias("stageId"), F.col("_s.name").alias("stage")
    )
    return wanted.join(t.deadline, ["projectId", "stageId"], "left").select(
        F.col("projectId").alias("project_id"),
        F.col("stageId").alias("stage_id"),
        "stage",
        F.col("finishdate").alias("finish_date"),
    )


def latest_project(t: Tables) -> DataFrame:
    """Project of each user's entry with the highest id."""
    return t.fact.groupBy(F.col("userId").alias("user_id")).agg(
        F.max_by("projectId", "id").alias("project_id")
    )


def user_directory(t: Tables) -> DataFrame:
    """Active users first, then by id."""
    return t.user.orderBy(F.desc("relevant"), "id").select(
        "id",
        "name",
        F.col("username").alias("login"),
        "color",
        to_css(F.col("color")).alias("css"),
        yes_no(F.col("admin")).alias("admin"),
        status_label(F.col("relevant"), 1).alias("status"),
    )


def project_directory(t: Tables) -> DataFrame:
    """Newest project first."""
    return t.project.orderBy(F.desc("id")).select(
        "id", "name", "square", "startdate", status_label(F.col("isDone"), 0).alias("status")
    )


# ---------------------------------------------------------------- lookups by a list of keys


def users_by_id(t: Tables, keys: DataFrame) -> DataFrame:
    """Rows of the users whose id is in the `id` column of `keys`; each user once."""
    return t.user.join(keys.select("id").distinct(), "id", "left_semi")


def projects_by_id(t: Tables, keys: DataFrame) -> DataFrame:
    return t.project.join(keys.select("id").distinct(), "id", "left_semi")


def user_names_by_id(t: Tables, keys: DataFrame) -> DataFrame:
    return users_by_id(t, keys).select("id", "name")


def logins_by_id(t: Tables, keys: DataFrame) -> DataFrame:
    return users_by_id(t, keys).select("id", F.col("username").alias("login"))


def project_names_by_id(t: Tables, keys: DataFrame) -> DataFrame:
    return projects_by_id(t, keys).select("id", "name")


def project_titles_by_id(t: Tables, keys: DataFrame) -> DataFrame:
    """Names in capitals, as the calendar's title shows them."""
    return projects_by_id(t, keys).select("id", F.upper("name").alias("title"))


def users_by_login(t: Tables, keys: DataFrame) -> DataFrame:
    """Active users for the texts in the `login` column of `keys`: (login, id, name, color).

    Equality blind to case; `%` and `_` mean themselves.
    """
    wanted = keys.select("login").distinct()
    active = t.user.filter(F.col("relevant") == 1)
    shown = F.coalesce(to_hex(F.col("color")), F.lit(NO_LOGIN_COLOUR)).alias("color")
    return wanted.join(active, same_login(F.col("login"), F.col("username"))).select(
        "login", "id", "name", shown
    )


def logins_by_name(t: Tables, keys: DataFrame) -> DataFrame:
    """Logins of active users for the texts in the `name` column of `keys`: (asked, id, login)."""
    wanted = keys.select(F.col("name").alias("asked")).distinct()
    active = t.user.filter(F.col("relevant") == 1)
    return wanted.join(active, same_name(F.col("asked"), F.col("name"))).select(
        "asked", "id", F.col("username").alias("login")
    )


# ---------------------------------------------------------------- colours


def _people_of_projects(t: Tables, predicate=None) -> DataFrame:
    return t.fact.filter(all_of([predicate])).select("projectId", "userId").distinct()


def first_name_colours(t: Tables) -> DataFrame:
    """(project_id, first_name, color) of the people on each project; people without a colour
    are left out, and a name without a space has an empty first name."""
    people = t.user.filter(F.col("color").isNotNull()).select("id", "name", "color")
    return (
        _people_of_projects(t)
        .join(people, F.col("userId") == F.col("id"))
        .select(
            F.col("projectId").alias("project_id"),
            first_name(F.col("name")).alias("first_name"),
            to_hex(F.col("color")).alias("color"),
        )
        .distinct()
    )


def user_series_colours(t: Tables, year: int | None = None, month: int | None = None) -> DataFrame:
    """Line colour of each person on each project's chart: their own, or black."""
    seen = _people_of_projects(t, in_period(F.col("dateStamp"), year, month))
    people = t.user.select("id", "name", "color")
    return seen.join(people, F.col("userId") == F.col("id")).select(
        F.col("projectId").alias("project_id"),
        F.col("userId").alias("user_id"),
        F.col("name").alias("user"),
        F.coalesce(to_hex(F.col("color")), F.lit(FALLBACK_HEX)).alias("color"),
    )


def project_series_colours(t: Tables, year: int | None = None, month: int | None = None) -> DataFrame:
    """Line colour of each project on each person's chart: palette by position in name order."""
    seen = _people_of_projects(t, in_period(F.col("dateStamp"), year, month))
    named = seen.join(t.project.select("id", "name"), F.col("projectId") == F.col("id")).select(
        F.col("userId").alias("user_id"),
        F.col("projectId").alias("project_id"),
        F.col("name").alias("project"),
    )
    # One person's projects, each once.
    by_name = W.partitionBy("user_id").orderBy("project", "project_id")
    placed = named.withColumn("_pos", F.row_number().over(by_name))
    palette = F.array(*[F.lit(c) for c in PALETTE])
    index = ((F.col("_pos") - 1) % len(PALETTE)).cast("int")
    return placed.select(
        "user_id", "project_id", "project", F.get(palette, index).alias("color")
    )
