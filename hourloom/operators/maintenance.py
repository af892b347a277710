"""Keeping users, projects and deadlines: inserts, partial updates, deletes, validation.

Batches carry a unique `seq`, the order of arrival. A partial update names the columns it
sets in an array column `fields`, so that NULL can be set on purpose. Updates apply the rows
that pass their check; `rejected` of the same check has the others with their reasons. Of
several rows for one id the last that names a field sets it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions.colours import NEW_USER_COLOUR, from_hex, is_hex
from hourloom.functions.text import NAME_COLLATION
from hourloom.plans.ids import arrival_ids, lowest, next_id
from hourloom.schema import DEADLINE, PROJECT, STAGE_NAMES, USER, Tables

USER_FIELDS = [f.name for f in USER if f.name != "id"]
PROJECT_FIELDS = [f.name for f in PROJECT if f.name != "id"]
_STAGE_IDS = range(1, len(STAGE_NAMES) + 1)
DEADLINE_FIELDS = [f"stage{i}" for i in _STAGE_IDS]


# ---------------------------------------------------------------- validation


def _missing(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == "")


def _bad_flag(column: str) -> Column:
    number = F.col(column).cast("string").try_cast("int")
    return F.col(column).isNotNull() & ~F.coalesce(number.isin(0, 1), F.lit(False))


def _bad_number(column: str) -> Column:
    text = F.col(column).cast("string")
    return ~_missing(column) & text.try_cast("int").isNull()


def _reasons(**checks: Column) -> Column:
    """Names of the failed checks, joined; empty when all pass."""
    return F.concat_ws(
        ", ", *[F.when(bad, F.lit(name.replace("_", " "))) for name, bad in checks.items()]
    )


def check_new_users(rows: DataFrame) -> DataFrame:
    """The batch with a `reason` column, empty for rows that may be inserted."""
    return rows.withColumn(
        "reason",
        _reasons(
            no_name=_missing("name"),
            no_login=_missing("username"),
            bad_admin=_bad_flag("admin"),
            bad_relevant=_bad_flag("relevant"),
            bad_color=F.col("color").isNotNull() & ~is_hex(F.col("color")),
        ),
    )


def check_new_projects(t: Tables, rows: DataFrame) -> DataFrame:
    """The batch with a `reason` column. Names are unique, blind to case and accents: against
    the stored projects, and inside the batch the first arrival keeps the name.

    The batch is reduced to the first row per name before it meets the stored names, and
    the verdict comes back by `seq`, so a name repeated many times forms no hot join key.
    """
    same = F.collate(F.col("name"), NAME_COLLATION)
    firsts = rows.filter(~_missing("name")).groupBy(same.alias("_name")).agg(F.min("seq").alias("seq"))
    stored = t.project.select(same.alias("_stored"))
    verdict = firsts.join(
        stored.withColumn("_taken", F.lit(True)), F.col("_name") == F.col("_stored"), "left"
    ).select("seq", F.coalesce("_taken", F.lit(False)).alias("_taken"))
    known = rows.join(verdict, "seq", "left")
    named = ~_missing("name")
    return known.withColumn(
        "reason",
        _reasons(
            no_name=_missing("name"),
            no_square=_missing("square"),
            bad_square=_bad_number("square"),
            name_taken=F.coalesce("_taken", F.lit(False)),
            name_repeated=named & F.col("_taken").isNull(),
            bad_isDone=_bad_flag("isDone"),
        ),
    ).drop("_taken")


def _named(patch: DataFrame, column: str) -> Column:
    """Whether a patch row sets the column."""
    if column not in patch.columns:
        return F.lit(False)
    return F.coalesce(F.array_contains("fields", column), F.lit(False))


def _bad_if_named(patch: DataFrame, checks: dict[str, tuple[str, Callable[[], Column]]]) -> Column:
    """Reasons of the failed checks among the fields a row names: reason -> (field, is bad)."""
    found = {
        reason: _named(patch, field) & bad()
        for reason, (field, bad) in checks.items()
        if field in patch.columns
    }
    return _reasons(**found) if found else F.lit("")


def check_user_patch(patch: DataFrame) -> DataFrame:
    """The patch with a `reason` column, empty for rows that may be applied."""
    return patch.withColumn(
        "reason",
        _bad_if_named(
            patch,
            {
                "no_name": ("name", lambda: _missing("name")),
                "no_login": ("username", lambda: _missing("username")),
                "bad_admin": ("admin", lambda: _missing("admin") | _bad_flag("admin")),
                "bad_relevant": ("relevant", lambda: _missing("relevant") | _bad_flag("relevant")),
                "bad_color": (
                    "color",
                    lambda: F.col("color").isNotNull()
                    & ~F.coalesce(is_hex(F.col("color")), F.lit(False)),
                ),
            },
        ),
    )


def check_project_patch(t: Tables, patch: DataFrame) -> DataFrame:
    """The patch with a `reason` column. A new name must not be another stored project's, and
    of several projects that ask for one name the first arrival gets it, blind to case and
    accents. Verdicts come back by `seq`, as for inserts."""
    checks = {
        "no_name": ("name", lambda: _missing("name")),
        "bad_square": ("square", lambda: _bad_number("square")),
        "bad_level": ("level", lambda: _bad_number("level")),
        "bad_isDone": ("isDone", lambda: _missing("isDone") | _bad_flag("isDone")),
    }
    if "name" not in patch.columns:
        return patch.withColumn("reason", _bad_if_named(patch, checks))
    same = F.collate(F.col("name"), NAME_COLLATION)
    asked = patch.filter(_named(patch, "name") & ~_missing("name"))
    asked = asked.select("seq", F.col("id").alias("_id"), same.alias("_name"))
    firsts = asked.groupBy("_name").agg(F.min(F.struct("seq", "_id")).alias("_first"))
    stored = t.project.groupBy(same.alias("_name")).agg(
        F.min("id").alias("_low"), F.max("id").alias("_high")
    )
    # Names of the batch, once each, meet the stored ones.
    other = (F.col("_low") != F.col("_id")) | (F.col("_high") != F.col("_id"))
    verdicts = asked.join(firsts.join(stored, "_name", "left"), "_name").select(
        "seq",
        F.coalesce(other, F.lit(False)).alias("_taken"),
        (F.col("_first._id") != F.col("_id")).alias("_repeated"),
    )
    told = patch.join(verdicts, "seq", "left")
    no = F.lit(False)
    names = _reasons(
        name_taken=F.coalesce("_taken", no), name_repeated=F.coalesce("_repeated", no)
    )
    both = F.concat_ws(", ", *[F.nullif(r, F.lit("")) for r in (_bad_if_named(patch, checks), names)])
    return told.withColumn("reason", both).drop("_taken", "_repeated")


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason") == "").drop("reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason") != "")


# ---------------------------------------------------------------- inserts


def _typed(rows: DataFrame, schema, defaults: dict[str, Column]) -> list[Column]:
    columns = []
    for f in schema:
        if f.name == "id":
            continue
        value = F.col(f.name) if f.name in rows.columns else F.lit(None)
        value = value.cast(f.dataType)
        if f.name in defaults:
            value = F.coalesce(value, defaults[f.name].cast(f.dataType))
        columns.append(value.alias(f.name))
    return columns


def insert_users(t: Tables, rows: DataFrame, first_id: Column | None = None) -> Tables:
    """Add checked users: no rights, active and grey unless given; colours come as #rrggbb.
    `first_id` is the first id never given out; by default the one after the highest stored,
    which may have been a deleted user's."""
    first_id = next_id(t.user) if first_id is None else first_id
    if "color" in rows.columns:
        rows = rows.withColumn("color", from_hex(F.col("color")))
    defaults = {"admin": F.lit(0), "relevant": F.lit(1), "color": F.lit(NEW_USER_COLOUR)}
    new = rows.select(
        arrival_ids(first_id, F.col("seq"), lowest(rows)).alias("id"),
        *_typed(rows, USER, defaults),
    )
    return t.with_(user=t.user.unionByName(new))


def insert_projects(
    t: Tables, rows: DataFrame, today: dt.date, first_id: Column | None = None
) -> Tables:
    """Add checked projects: current, level 1 and starting today unless given, each with its
    six stage rows. Deadlines come in columns stage1..stage6; a missing one is NULL.
    `first_id` as for users."""
    first_id = next_id(t.project) if first_id is None else first_id
    defaults = {"isDone": F.lit(0), "level": F.lit(1), "startdate": F.lit(today)}
    dates = [
        F.col(c).cast("date") if c in rows.columns else F.lit(None).cast("date")
        for c in DEADLINE_FIELDS
    ]
    new = rows.select(
        arrival_ids(first_id, F.col("seq"), lowest(rows)).alias("id"),
        *_typed(rows, PROJECT, defaults),
        F.array(*dates).alias("_dates"),
    )
    stages = new.select(
        F.col("id").alias("projectId"), F.posexplode("_dates").alias("_pos", "finishdate")
    ).select("projectId", (F.col("_pos") + 1).alias("stageId"), "finishdate")
    return t.with_(
        project=t.project.unionByName(new.drop("_dates")),
        deadline=t.deadline.unionByName(stages.select(*DEADLINE.fieldNames())),
    )


# ---------------------------------------------------------------- partial updates


def _patched(table: DataFrame, patch: DataFrame, fields: list[str], schema) -> DataFrame:
    """Set the named fields of the patched rows. The patch is first reduced to one row per
    id: for each field the value of the last row that names it."""
    given = [c for c in fields if c in patch.columns]
    last = patch.groupBy("id").agg(
        *[F.max_by(c, F.when(_named(patch, c), F.col("seq"))).alias(f"_new_{c}") for c in given],
        *[F.max(_named(patch, c)).alias(f"_set_{c}") for c in given],
    )
    joined = table.join(last, "id", "left")
    columns = []
    for f in schema:
        if f.name in given:
            value = F.col(f"_new_{f.name}")
            if dict(patch.dtypes)[f.name] == "string":
                value = value.try_cast(f.dataType)
            columns.append(
                F.when(F.col(f"_set_{f.name}"), value.cast(f.dataType))
                .otherwise(F.col(f.name))
                .alias(f.name)
            )
        else:
            columns.append(F.col(f.name))
    return joined.select(*columns)


def update_users(t: Tables, patch: DataFrame) -> Tables:
    """Apply the rows of the patch that pass `check_user_patch`."""
    patch = accepted(check_user_patch(patch))
    if "color" in patch.columns:
        patch = patch.withColumn("color", from_hex(F.col("color")))
    return t.with_(user=_patched(t.user, patch, USER_FIELDS, USER))


def update_projects(t: Tables, patch: DataFrame) -> Tables:
    """Apply the rows of the patch that pass `check_project_patch`."""
    patch = accepted(check_project_patch(t, patch))
    return t.with_(project=_patched(t.project, patch, PROJECT_FIELDS, PROJECT))


def patch_deadlines(t: Tables, patch: DataFrame) -> Tables:
    """New finish dates by (projectId, stageId), the last arrival's where there are several;
    other stages keep theirs, and a pair that is not stored is not added."""
    given = patch.groupBy("projectId", "stageId").agg(
        F.max_by("finishdate", "seq").alias("_new"), F.lit(True).alias("_given")
    )
    patched = t.deadline.join(given, ["projectId", "stageId"], "left").select(
        "projectId",
        "stageId",
        F.when(F.col("_given"), F.col("_new")).otherwise(F.col("finishdate")).alias("finishdate"),
    )
    return t.with_(deadline=patched)


# ---------------------------------------------------------------- deletes


def delete_users(t: Tables, ids: DataFrame) -> Tables:
    """Drop users and all their entries."""
    gone = ids.select("id").distinct()
    return t.with_(
        fact=t.fact.join(gone, t.fact.userId == gone.id, "left_anti"),
        user=t.user.join(gone, "id", "left_anti"),
    )


def delete_projects(t: Tables, ids: DataFrame) -> Tables:
    """Drop projects with their entries and deadlines."""
    gone = ids.select("id").distinct()
    return t.with_(
        fact=t.fact.join(gone, t.fact.projectId == gone.id, "left_anti"),
        deadline=t.deadline.join(gone, t.deadline.projectId == gone.id, "left_anti"),
        project=t.project.join(gone, "id", "left_anti"),
    )
