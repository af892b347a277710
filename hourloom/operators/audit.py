"""Integrity audit: one row per class of finding with its count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions.colours import is_colour
from hourloom.functions.text import NAME_COLLATION
from hourloom.operators.slot_rules import SEATS
from hourloom.schema import GRID_HOURS, SCHEMAS, SLOT, Tables
from hourloom.session import fresh_dir

MAX_LEVEL = 5


def _rows_where(table: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Counts of several conditions from one scan, in long form."""
    counts = table.agg(*[F.count_if(bad).alias(f"c{i}") for i, bad in enumerate(checks.values())])
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("finding"), F.col(f"c{i}").alias("n"))
            for i, name in enumerate(checks)
        ]
    )
    return counts.select(F.inline(pairs))


def _groups_where(table: DataFrame, finding: str, keys: list, bad: Column, *aggs: Column) -> DataFrame:
    """Count of groups that break a rule; grouping combines before the shuffle."""
    return table.groupBy(*keys).agg(*aggs).agg(F.count_if(bad).alias("n")).select(
        F.lit(finding).alias("finding"), "n"
    )


def orphans(
    table: DataFrame, finding: str, key: str, parent: DataFrame, rows: str | None = None
) -> DataFrame:
    """Rows whose key has no parent; column `rows` says how many a row stands for. Counted
    per key before the join, so no key is hot."""
    count = F.sum(rows) if rows else F.count(F.lit(1))
    per_key = table.groupBy(F.col(key).alias("_key")).agg(count.alias("_n"))
    known = parent.select(F.col("id").alias("_id"))
    lost = per_key.join(known, F.col("_key") == F.col("_id"), "left_anti")
    return lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).select(
        F.lit(finding).alias("finding"), "n"
    )


def entry_checks(fact: DataFrame) -> dict[str, Column]:
    """What each entry of the log must hold."""
    return {**_nulls("main", fact), "main: hours out of range": ~F.col("hours").between(1, GRID_HOURS)}


def summed_entries(fact: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per slot and person: entries (`_rows`), hours (`_hours`) and how many entries
    fail each check (`_c0`, ...)."""
    return fact.groupBy(*SLOT, "userId").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(F.col("hours").cast("int")).alias("_hours"),
        *[F.count_if(bad).alias(f"_c{i}") for i, bad in enumerate(checks.values())],
    )


def _summary(fact: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """The summed entries, written once: all but one of the fact's findings roll them up, so
    the fact is scanned once for them."""
    path = fresh_dir(fact.sparkSession, "audit")
    summary = summed_entries(fact, checks)
    summary.write.parquet(path)
    return fact.sparkSession.read.schema(summary.schema).parquet(path)


def summed(summary: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Entries that fail each check, from the summary."""
    counts = summary.agg(
        *[F.coalesce(F.sum(f"_c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(checks))]
    )
    pairs = [F.struct(F.lit(f).alias("finding"), F.col(f"c{i}").alias("n")) for i, f in enumerate(checks)]
    return counts.select(F.inline(F.array(*pairs)))


def slot_findings(per_person: DataFrame) -> DataFrame:
    """Doubled entries and over-full slots."""
    per_slot = per_person.groupBy(*SLOT).agg(
        F.count_if(F.col("_rows") > 1).alias("_doubled"), F.count(F.lit(1)).alias("_people")
    )
    counts = per_slot.agg(
        F.coalesce(F.sum("_doubled"), F.lit(0)).alias("doubled"),
        F.count_if(F.col("_people") > SEATS).alias("full"),
    )
    rows = [("main: entry doubled", "doubled"), ("main: slot over-full", "full")]
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(f).alias("finding"), F.col(c).alias("n")) for f, c in rows]))
    )


def _nulls(name: str, table: DataFrame) -> dict[str, Column]:
    required = [f.name for f in SCHEMAS[name] if not f.nullable and f.name in table.columns]
    return {f"{name}: {c} missing": F.col(c).isNull() for c in required}


def _not_in(column: str, *values: int) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).isin(*values)


def integrity_audit(t: Tables, key: tuple[str, ...] | None = None) -> DataFrame:
    """(finding, n) for duplicated keys, missing values, orphans, values out of range,
    doubled and over-full slots, overlong days and unreadable colours.

    `key` names the columns that identify an entry; by default the tie keys of the tables.
    """
    more = F.col("_n") > 1
    count = F.count(F.lit(1)).alias("_n")
    hours = F.sum("_hours").alias("_n")
    same_name = F.collate(F.col("name"), NAME_COLLATION).alias("_name")
    entry_key = list(key or t.tie_keys)
    if key is None and entry_key != ["id"]:
        entry_key = ["dateStamp", *entry_key]
    checks = entry_checks(t.fact)
    summary = _summary(t.fact, checks)
    findings = [
        _groups_where(t.fact, "main: key repeated", entry_key, more, count),
        _groups_where(t.project, "project: id repeated", ["id"], more, count),
        _groups_where(t.project, "project: name repeated", [same_name], more, count),
        _groups_where(t.deadline, "projectstage: key repeated", ["projectId", "stageId"], more, count),
        _groups_where(t.stage, "stage: id repeated", ["id"], more, count),
        _groups_where(t.user, "user: id repeated", ["id"], more, count),
        summed(summary, checks),
        _rows_where(
            t.project,
            {
                **_nulls("project", t.project),
                "project: isDone not a flag": _not_in("isDone", 0, 1),
                "project: level out of range": ~F.col("level").between(1, MAX_LEVEL),
            },
        ),
        _rows_where(
            t.deadline,
            {
                **_nulls("projectstage", t.deadline),
                "projectstage: finishdate missing": F.col("finishdate").isNull(),
            },
        ),
        _rows_where(t.stage, _nulls("stage", t.stage)),
        _rows_where(
            t.user,
            {
                **_nulls("user", t.user),
                "user: admin not a flag": _not_in("admin", 0, 1),
                "user: relevant not a flag": _not_in("relevant", 0, 1),
                "user: color unreadable": F.col("color").isNotNull() & ~is_colour(F.col("color")),
            },
        ),
        orphans(summary, "main: user unknown", "userId", t.user, "_rows"),
        orphans(summary, "main: project unknown", "projectId", t.project, "_rows"),
        orphans(summary, "main: stage unknown", "stageId", t.stage, "_rows"),
        orphans(t.deadline, "projectstage: project unknown", "projectId", t.project),
        orphans(t.deadline, "projectstage: stage unknown", "stageId", t.stage),
        slot_findings(summary),
        _groups_where(
            summary, "main: day too long", ["userId", "dateStamp"], F.col("_n") > GRID_HOURS, hours
        ),
    ]
    return reduce(DataFrame.unionByName, findings).select("finding", F.col("n").cast("long").alias("n"))
