"""Work-log views over the driver's parquet tables (mapping in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.schema import STAGE, STAGE_NAMES, Tables

# Event types in order of the stage ids 1..5 they stand for.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


# Stated so that no job reads footers to find them.
SOURCE_SCHEMAS = {
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_shipdate TIMESTAMP_NTZ"
    ),
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT",
    "part": "p_partkey BIGINT, p_name STRING, p_type STRING, p_size INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT",
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
        "props STRING"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(STAGE_NAMES, start=1)), STAGE)


def long_log(spark: SparkSession, sf_dir: str, dated: bool = False) -> Tables:
    """Seven years of entries: lineitem as fact, supplier as user, part as project.

    A project's start date is worked out from its entries; it is NULL unless `dated`, since
    most reports do not read it.
    """
    fact = _long_facts(spark, sf_dir)
    user = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id",
        "s_name AS name",
        "concat('0.', lpad(CAST(s_nationkey AS STRING), 2, '0'), ',0.5,0.25,1') AS color",
        "lower(s_name) AS username",
        "CAST(s_suppkey % 5 = 0 AS INT) AS admin",
        "CAST(s_suppkey % 7 <> 0 AS INT) AS relevant",
    )
    return Tables(
        fact=fact,
        project=_projects(spark, sf_dir, fact if dated else None),
        deadline=_deadlines(spark, sf_dir, fact),
        stage=stages(spark),
        user=user,
        tie_keys=("orderKey", "stageId", "projectId", "userId", "hours"),
    )


def _long_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS userId",
        "l_partkey AS projectId",
        "l_linenumber AS stageId",
        "CAST(l_shipdate AS DATE) AS dateStamp",
        "CAST(l_quantity AS INT) AS hours",
        "l_orderkey AS orderKey",
    )


def _projects(spark: SparkSession, sf_dir: str, fact: DataFrame | None) -> DataFrame:
    part = table(spark, sf_dir, "part")
    if fact is None:
        part = part.selectExpr("*", "CAST(NULL AS DATE) AS startdate")
    else:
        started = fact.groupBy("projectId").agg(F.min("dateStamp").alias("startdate"))
        part = part.join(started, part.p_partkey == started.projectId, "left")
    return part.selectExpr(
        "p_partkey AS id",
        "concat_ws(' ', p_name, CAST(p_partkey AS STRING)) AS name",
        "p_size AS square",
        "CAST(p_partkey % 5 + 1 AS INT) AS level",
        "startdate",
        "CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 0 ELSE 1 END AS isDone",
    )


def _deadlines(spark: SparkSession, sf_dir: str, fact: DataFrame) -> DataFrame:
    finished = fact.groupBy("projectId", "stageId").agg(F.max("dateStamp").alias("finishdate"))
    return (
        table(spark, sf_dir, "part")
        .selectExpr("p_partkey AS projectId", "explode(sequence(1, 6)) AS stageId")
        .join(finished, ["projectId", "stageId"], "left")
    )


def month_log(spark: SparkSession, sf_dir: str, folded: bool = False) -> Tables:
    """One month of entries: events as fact, customer as user, part as project.

    `folded` maps users to 10 and projects to 5 ids, so that slots and neighbour days fill up.
    """
    fact = calendar_facts(table(spark, sf_dir, "events"), folded)
    user = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        "c_name AS name",
        "concat('0.', lpad(CAST(c_nationkey AS STRING), 2, '0'), ',0.5,0.25,1') AS color",
        "lower(c_name) AS username",
        "0 AS admin",
        "1 AS relevant",
    )
    return Tables(
        fact=fact,
        project=_projects(spark, sf_dir, None),
        deadline=_deadlines(spark, sf_dir, _long_facts(spark, sf_dir)),
        stage=stages(spark),
        user=user,
    )


def _calendar_columns(folded: bool) -> dict[str, str]:
    project = "CAST(get_json_object(props, '$.k') AS BIGINT)"
    types = ", ".join(f"'{t}'" for t in EVENT_TYPES)
    return {
        "userId": "user_id % 10" if folded else "user_id",
        "projectId": f"{project} % 5" if folded else project,
        "stageId": f"CAST(array_position(array({types}), event_type) AS INT)",
        "dateStamp": "CAST(ts AS DATE)",
        "hours": "CAST(least(12, greatest(1, ceil(value / 20))) AS INT)",
    }


def calendar_facts(events: DataFrame, folded: bool = False) -> DataFrame:
    columns = [f"{e} AS {n}" for n, e in _calendar_columns(folded).items()]
    return events.selectExpr("event_id AS id", *columns)


def calendar_edits(
    events: DataFrame, folded: bool = False, deletes: bool = True, next_user: bool = False
) -> DataFrame:
    """Each event as one edit command; every tenth is a delete unless `deletes` is off.

    `next_user` moves every edit to the following user id, so that edits meet other
    people's entries when the same events are the snapshot.
    """
    columns = _calendar_columns(folded)
    columns["hour"] = columns.pop("hours")
    if next_user:
        columns["userId"] += " + 1"
    op = "IF(event_id % 10 = 0, 'delete', 'set')" if deletes else "'set'"
    return events.selectExpr(
        "CAST(ts AS TIMESTAMP) AS ts",
        "event_id AS seq",
        f"{op} AS op",
        *[f"{e} AS {n}" for n, e in columns.items()],
    )
