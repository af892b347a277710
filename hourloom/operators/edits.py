"""Applying calendar edits to a snapshot of the log.

An edit is (ts, seq, op, userId, projectId, stageId, dateStamp, hour); `seq` is unique and
(ts, seq) is the order of arrival. A slot takes at most two people.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from hourloom.functions.dates import date_of
from hourloom.operators.slot_rules import DAY_FULL, SAVED, SEATS
from hourloom.operators.slot_runs import run_slots
from hourloom.plans.ids import arrival_ids, lowest, next_id
from hourloom.plans.joins import spread_join
from hourloom.schema import EDIT, FACT, GRID_HOURS, SLOT
from hourloom.session import fresh_dir

ENTRY = [*SLOT, "userId"]

_FACT_COLUMNS = FACT.fieldNames()


@dataclass(frozen=True)
class Outcome:
    """`entries`: the whole log after the edits. `statuses`: (seq, status) per edit."""

    entries: DataFrame
    statuses: DataFrame


def _edited_days(edits: DataFrame) -> Column:
    """Range of days the edits touch, as literals the fact scan can skip row groups by."""
    low, high = edits.agg(F.min("dateStamp"), F.max("dateStamp")).first()
    if low is None:
        return F.lit(False)
    return F.col("dateStamp").between(F.lit(low), F.lit(high))


def _touched_entries(snapshot: DataFrame, edits: DataFrame, days: Column) -> DataFrame:
    slots = edits.select(*SLOT).distinct()
    return snapshot.filter(days).join(slots, SLOT, "left_semi")


def _seated(held: DataFrame, edits: DataFrame) -> DataFrame:
    """(entry key, first, new_hours, own_id) of the people whose edits are saved, when the
    edits only set hours; `own_id` is their entry in `held`, if any."""
    arrival = F.struct("ts", "seq")
    edited = edits.groupBy(*ENTRY).agg(
        F.min(arrival).alias("first"), F.max_by("hour", arrival).alias("new_hours")
    )
    owned = held.groupBy(*ENTRY).agg(F.min("id").alias("own_id"))
    no_first = F.lit(None).cast(edited.schema["first"].dataType)
    people = (
        edited.withColumn("own_id", F.lit(None).cast("long"))
        .unionByName(
            owned.select(
                *ENTRY,
                no_first.alias("first"),
                F.lit(None).cast("int").alias("new_hours"),
                "own_id",
            )
        )
        .groupBy(*ENTRY)
        .agg(
            F.min("first").alias("first"),
            F.max("new_hours").alias("new_hours"),
            F.min("own_id").alias("own_id"),
            F.min(F.col("own_id").isNull().cast("int")).alias("newcomer"),
        )
    )
    by_arrival = W.partitionBy(*SLOT).orderBy("newcomer", "first", "userId")
    return (
        people.withColumn("rank", F.row_number().over(by_arrival))
        .filter(F.col("rank") <= SEATS + 1)
        .withColumn("held_by", F.sum(1 - F.col("newcomer")).over(W.partitionBy(*SLOT)))
        .filter(
            (F.col("rank") <= SEATS)
            & (F.col("held_by") <= SEATS)
            & F.col("new_hours").isNotNull()
        )
        .select(*ENTRY, "first", "new_hours", "own_id")
    )


def _added(saved: DataFrame, first_id: Column, edits: DataFrame) -> DataFrame:
    return saved.filter(F.col("own_id").isNull()).select(
        arrival_ids(first_id, F.col("first.seq"), lowest(edits)).alias("id"),
        "userId",
        "projectId",
        "stageId",
        "dateStamp",
        F.col("new_hours").alias("hours"),
    )


def _updated(rows: DataFrame, saved: DataFrame) -> DataFrame:
    changed = saved.filter(F.col("own_id").isNotNull()).select(
        F.col("own_id").alias("id"), "new_hours"
    )
    joined = rows.join(changed, "id", "left")
    return joined.withColumn("hours", F.coalesce("new_hours", "hours")).select(*_FACT_COLUMNS)


def _set_statuses(edits: DataFrame, saved: DataFrame) -> DataFrame:
    return edits.join(saved.select(*ENTRY, F.lit(SAVED).alias("status")), ENTRY, "left").select(
        "seq", F.coalesce("status", F.lit(DAY_FULL)).alias("status")
    )


def read_commands(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clicks given by year, month and day as (edits, rejected): a rejected click has no such
    day, an unknown op, or an hour that is not on the grid."""
    dated = raw.withColumn("dateStamp", date_of(F.col("year"), F.col("month"), F.col("day")))
    reason = F.concat_ws(
        ", ",
        F.when(F.col("dateStamp").isNull(), F.lit("no such day")),
        F.when(~F.coalesce(F.col("op").isin("set", "delete"), F.lit(False)), F.lit("unknown op")),
        F.when(
            ~F.coalesce(F.col("hour").between(1, GRID_HOURS), F.lit(False)), F.lit("bad hour")
        ),
    )
    checked = dated.withColumn("reason", reason)
    edits = checked.filter(F.col("reason") == "").select(*EDIT.fieldNames())
    return edits, checked.filter(F.col("reason") != "").drop("dateStamp")


# ---------------------------------------------------------------- upserts only


def upsert_entries(snapshot: DataFrame, edits: DataFrame, first_id: Column | None = None) -> Outcome:
    """Apply edits that only set hours.

    Without deletes a person who gets into a slot stays, so who gets in depends only on who
    is there and who arrives first: people of the snapshot, then newcomers by first edit,
    up to two. Each person keeps the hours of their last edit. A slot with three or more
    people in the snapshot accepts nothing.

    Edits are combined per slot and person before any shuffle, and the ranking keeps at
    most three people per slot on the map side, so a slot with a third of all edits is
    small by the time it meets in one task.
    """
    first_id = next_id(snapshot) if first_id is None else first_id
    days = _edited_days(edits)
    saved = _seated(_touched_entries(snapshot, edits, days), edits)
    entries = (
        snapshot.filter(~days)
        .select(*_FACT_COLUMNS)
        .unionByName(_updated(snapshot.filter(days), saved))
        .unionByName(_added(saved, first_id, edits))
    )
    return Outcome(entries, _set_statuses(edits, saved))


# ---------------------------------------------------------------- upserts and deletes

_STEP = [*SLOT, "userId", "seed", "ts", "seq", "op", "hour"]


def _steps(held: DataFrame, edits: DataFrame) -> DataFrame:
    """Snapshot entries as first steps (seed = 0, seq = id), then the edits (seed = 1)."""
    seeds = held.select(
        *ENTRY,
        F.lit(0).alias("seed"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.col("id").alias("seq"),
        F.lit("set").alias("op"),
        F.col("hours").alias("hour"),
    )
    commands = edits.select(
        *ENTRY, F.lit(1).alias("seed"), "ts", "seq", "op", "hour"
    )
    return seeds.select(*_STEP).unionByName(commands.select(*_STEP))


def _split(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps back as snapshot rows and edits."""
    rows = steps.filter(F.col("seed") == 0).withColumnsRenamed({"hour": "hours", "seq": "id"})
    return rows.select(*_FACT_COLUMNS), steps.filter(F.col("seed") == 1)


def _by_kind(steps: DataFrame) -> Callable[[str], DataFrame]:
    """Sort the steps out by kind of slot: `settled` without deletes, `ordered` otherwise.
    Deletes are counted per person first, so a hot slot is combined before it meets. The
    result is written once, split by kind, and each kind reads back its own part; it holds
    the batch and the entries it touches."""
    spark = steps.sparkSession
    path = fresh_dir(spark, "edit-steps")
    deletes = F.max((F.col("op") == "delete").cast("int")).alias("_deletes")
    kinds = steps.groupBy(*SLOT).agg(deletes).select(
        *SLOT, F.when(F.col("_deletes") == 0, "settled").otherwise("ordered").alias("kind")
    )
    marked = spread_join(steps, kinds, SLOT)
    marked.write.partitionBy("kind").parquet(path)
    schema = StructType([*(marked.schema[c] for c in _STEP), marked.schema["kind"]])
    stored = spark.read.schema(schema).parquet(path)
    return lambda kind: stored.filter(F.col("kind") == kind).select(*_STEP)


def apply_edits(snapshot: DataFrame, edits: DataFrame, first_id: Column | None = None) -> Outcome:
    """Apply sets and deletes in order of arrival.

    A set is refused when two others hold the slot; a delete removes the person's own entry
    (the one with the lowest id) when its hour is at most the entry's hours, in an over-full
    slot too, which takes sets again once deletes have brought it down.

    Slots without deletes need no order, see `upsert_entries`. The others run in order, each
    cut into as many stretches as it has ranges of rows, see `slot_runs`; a hot slot, or one
    person's many edits of a slot, spread over tasks. The outcome is written once for both
    results.
    """
    first_id = next_id(snapshot) if first_id is None else first_id
    days = _edited_days(edits)
    held = _touched_entries(snapshot, edits, days)
    of_kind = _by_kind(_steps(held, edits))
    done = run_slots(of_kind("ordered"))
    results = done.filter(F.col("status").isNull()).select(
        F.coalesce("id", arrival_ids(first_id, F.col("born"), lowest(edits))).alias("id"),
        "userId",
        "projectId",
        "stageId",
        "dateStamp",
        "hours",
    )
    settled_rows, settled_edits = _split(of_kind("settled"))
    saved = _seated(settled_rows, settled_edits)
    slots = edits.select(*SLOT).distinct()
    untouched = snapshot.filter(days).join(slots, SLOT, "left_anti")
    entries = (
        snapshot.filter(~days)
        .select(*_FACT_COLUMNS)
        .unionByName(untouched.select(*_FACT_COLUMNS))
        .unionByName(_updated(settled_rows, saved))
        .unionByName(_added(saved, first_id, edits))
        .unionByName(results)
    )
    statuses = (
        done.filter(F.col("status").isNotNull())
        .select("seq", "status")
        .unionByName(_set_statuses(settled_edits, saved))
    )
    return Outcome(entries, statuses)
