"""Table schemas, fixed lists and the `Tables` bundle every operator takes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FACT = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("userId", T.LongType(), False),
        T.StructField("projectId", T.LongType(), False),
        T.StructField("stageId", T.IntegerType(), False),
        T.StructField("dateStamp", T.DateType(), False),
        T.StructField("hours", T.IntegerType(), False),
    ]
)

PROJECT = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("square", T.IntegerType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("startdate", T.DateType()),
        T.StructField("isDone", T.IntegerType(), False),
    ]
)

# finishdate may be NULL: a project can be entered before its deadlines are known.
DEADLINE = T.StructType(
    [
        T.StructField("projectId", T.LongType(), False),
        T.StructField("stageId", T.IntegerType(), False),
        T.StructField("finishdate", T.DateType()),
    ]
)

STAGE = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
    ]
)

# The login secret of the source table is never read.
USER = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("color", T.StringType()),
        T.StructField("username", T.StringType(), False),
        T.StructField("admin", T.IntegerType(), False),
        T.StructField("relevant", T.IntegerType(), False),
    ]
)

EDIT = T.StructType(
    [
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("userId", T.LongType(), False),
        T.StructField("projectId", T.LongType(), False),
        T.StructField("stageId", T.IntegerType(), False),
        T.StructField("dateStamp", T.DateType(), False),
        T.StructField("hour", T.IntegerType(), False),
    ]
)

SCHEMAS = {
    "main": FACT,
    "project": PROJECT,
    "projectstage": DEADLINE,
    "stage": STAGE,
    "user": USER,
}

# A slot is what the capacity rule is about; a slot and a user make one entry.
SLOT = ["projectId", "stageId", "dateStamp"]

# The six stage names in order of their ids 1..6.
STAGE_NAMES = [
    "ПОДГОТОВКА",
    "3D ГРАФИКА",
    "ЗАКАЗНЫЕ ПОЗИЦИИ",
    "СМР",
    "КОМПЛЕКТАЦИЯ",
    "РЕАЛИЗАЦИЯ",
]

# Marker for "group by this field, do not filter it", and the total label.
ALL = "Все"
TOTAL = "Σ"

# Relevance choices of the project board.
CURRENT = "Актуальные"
ARCHIVED = "Архивные"

# Hours on the calendar grid, rows on a work-log page.
GRID_HOURS = 12
PAGE_SIZE = 40


@dataclass(frozen=True)
class Tables:
    """The five tables, plus the columns that put fact rows of one day in a total order.

    `tie_keys` is `id` for real data; views without an id name other columns.
    """

    fact: DataFrame
    project: DataFrame
    deadline: DataFrame
    stage: DataFrame
    user: DataFrame
    tie_keys: tuple[str, ...] = ("id",)

    def with_(self, **changes) -> "Tables":
        return replace(self, **changes)
