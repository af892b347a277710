"""Stage by person matrix of a project, hours of a person by project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.functions.text import header, short_header
from hourloom.plans.joins import listed
from hourloom.plans.periods import in_period
from hourloom.plans.predicates import all_of
from hourloom.plans.wide import pivot_sum, pivot_values
from hourloom.schema import STAGE_NAMES, TOTAL, Tables


def _stage_columns() -> list[str]:
    return [f"s{i}" for i in range(1, len(STAGE_NAMES) + 1)]


def _per_user(t: Tables, year: int, month: int | None, project_id: int | None) -> DataFrame:
    """One row per project and user, one sum per listed stage.

    The six stages are fixed, so they are columns of one aggregate: missing stages are 0
    without a join, and a user with hours on other stages only still has a row.
    """
    only = None if project_id is None else F.col("projectId") == project_id
    stage = t.stage.select(F.col("id").alias("_stage"), F.col("name").alias("_stage_name"))
    hours = F.col("hours").cast("int")
    sums = [
        F.coalesce(F.sum(F.when(F.col("_stage_name") == name, hours)), F.lit(0)).alias(column)
        for column, name in zip(_stage_columns(), STAGE_NAMES)
    ]
    return (
        t.fact.filter(all_of([in_period(F.col("dateStamp"), year, month), only]))
        .join(listed(stage), F.col("stageId") == F.col("_stage"))
        .groupBy("projectId", "userId")
        .agg(*sums)
    )


def stage_matrix(
    t: Tables, year: int, month: int | None = None, project_id: int | None = None
) -> DataFrame:
    """Long form for all projects: (project_id, stage, user_id, user, hours, is_total).

    Totals carry the label TOTAL as stage, as user, or as both; cells and all totals come
    from one aggregate over grouping sets, of rows that are summed per person before.
    """
    per_user = _per_user(t, year, month, project_id).join(
        t.user.select(F.col("id").alias("user_id"), F.col("name").alias("user")),
        F.col("userId") == F.col("user_id"),
    )
    cells = [
        F.struct(F.lit(i).alias("stage_order"), F.lit(name).alias("stage"), F.col(c).alias("hours"))
        for i, (c, name) in enumerate(zip(_stage_columns(), STAGE_NAMES), start=1)
    ]
    cells = per_user.select(
        F.col("projectId").alias("project_id"), "user_id", "user", F.inline(F.array(*cells))
    )
    project, stage, person = ["project_id"], ["stage_order", "stage"], ["user_id", "user"]
    every = [[*project, *stage, *person], [*project, *stage], [*project, *person], project]
    sets = [[F.col(c) for c in s] for s in every]
    summed = cells.groupingSets(sets, *sets[0]).agg(
        F.sum("hours").alias("hours"),
        F.grouping("stage_order").alias("_all_stages"),
        F.grouping("user_id").alias("_all_people"),
    )
    of_all = lambda flag, label, value: F.when(F.col(flag) == 1, F.lit(label)).otherwise(F.col(value))
    return summed.select(
        "project_id",
        of_all("_all_stages", len(STAGE_NAMES) + 1, "stage_order").alias("stage_order"),
        of_all("_all_stages", TOTAL, "stage").alias("stage"),
        "user_id",
        of_all("_all_people", TOTAL, "user").alias("user"),
        "hours",
        F.greatest("_all_stages", "_all_people").cast("int").alias("is_total"),
    )


def stage_matrix_wide(
    t: Tables, project_id: int, year: int, month: int | None = None
) -> DataFrame:
    """The matrix of one project with a column per person on it, sorted by name, and TOTAL
    last; rows in stage order. For all projects there is the long form."""
    cells = stage_matrix(t, year, month, project_id)
    people = pivot_values(cells.filter(F.col("user") != TOTAL), "user")
    wide = pivot_sum(
        cells, ["project_id", "stage_order", "stage"], "user", "hours", [*people, TOTAL]
    )
    return wide.orderBy("project_id", "stage_order").drop("stage_order")


def _map_of(rows: DataFrame, index: list[str], key: str) -> DataFrame:
    """One row per index with a map from `key` to hours, keys in order; equal keys add up."""
    summed = rows.groupBy(*index, key).agg(F.sum("hours").alias("hours"))
    entries = F.sort_array(F.collect_list(F.struct(key, "hours")))
    return summed.groupBy(*index).agg(F.map_from_entries(entries).alias("hours"))


def stage_matrix_maps(t: Tables, year: int, month: int | None = None) -> DataFrame:
    """The matrices of all projects: per project and stage, totals included, one map from the
    people on the project (TOTAL for all of them) to hours. A row is as wide as its project
    has people, so no set of columns has to be known or bounded."""
    return _map_of(stage_matrix(t, year, month), ["project_id", "stage_order", "stage"], "user")


def user_project_maps(t: Tables, year: int, month: int | None = None) -> DataFrame:
    """All people's hours: per person one map from project to hours."""
    return _map_of(user_project_hours(t, year, month), ["user_id"], "project")


def matrix_headers(wide: DataFrame, index: tuple[str, ...] = ("project_id", "stage")) -> dict[str, str]:
    """Shown header of each column: the text before the first space."""
    return {c: c.partition(" ")[0] for c in wide.columns if c not in index}


def user_project_hours(
    t: Tables, year: int, month: int | None = None, user_id: int | None = None
) -> DataFrame:
    """Long form for all people: (user_id, project_id, project, header, hours)."""
    only = None if user_id is None else F.col("userId") == user_id
    summed = (
        t.fact.filter(all_of([in_period(F.col("dateStamp"), year, month), only]))
        .groupBy("userId", "projectId")
        .agg(F.sum(F.col("hours").cast("int")).alias("hours"))
    )
    projects = t.project.select("id", F.col("name").alias("project"))
    return summed.join(projects, F.col("projectId") == F.col("id")).select(
        F.col("userId").alias("user_id"),
        F.col("projectId").alias("project_id"),
        "project",
        short_header(F.col("project")).alias("header"),
        "hours",
    )


def user_project_hours_wide(
    t: Tables, user_id: int, year: int, month: int | None = None
) -> DataFrame:
    """One person's hours with a column per project, headed by at most 30 characters of its
    name. Projects whose cut names agree keep apart by a running suffix."""
    long = user_project_hours(t, year, month, user_id)
    projects = pivot_values(long, "project")
    wide = pivot_sum(long, ["user_id"], "project", "hours", projects)
    heads, used = {}, set()
    for name in projects:
        head, n = name[:30], 2
        while head in used:
            head, n = f"{name[:30]} ({n})", n + 1
        used.add(head)
        heads[name] = head
    return wide.withColumnsRenamed(heads)


def user_headers(people: DataFrame) -> DataFrame:
    """Matrix header of each user as a column."""
    return people.select("id", "name", header(F.col("name")).alias("header"))
