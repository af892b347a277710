"""Writing the tables: entries split by year, each write to new folders the caller names.

A log is a set of year folders (`YearFolders`). A change writes the years it touches to a new
place and keeps the folders of the others, so its cost follows the touched years.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from hourloom.operators.edits import apply_edits
from hourloom.schema import FACT, SCHEMAS, Tables

_YEARLY = StructType([*FACT, StructField("year", IntegerType())])


@dataclass(frozen=True)
class YearFolders:
    """The folder of each year that has entries, and the first id never given out."""

    folders: dict[int, str]
    next_id: int = 1

    def entries(self, spark: SparkSession, years: list[int] | None = None) -> DataFrame:
        """The log, or some years of it."""
        wanted = sorted(self.folders) if years is None else [y for y in years if y in self.folders]
        if not wanted:
            return spark.createDataFrame([], FACT)
        return spark.read.schema(FACT).parquet(*[self.folders[y] for y in wanted])


@dataclass(frozen=True)
class Published:
    years: YearFolders
    statuses: DataFrame


def save_entries(entries: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The fact, one folder per year. Rows of a year go to few files; a huge year is split by
    the rebalancing. By default Spark refuses a folder that exists."""
    yearly = entries.select(*FACT.fieldNames(), F.year("dateStamp").alias("year"))
    yearly.hint("rebalance", "year").write.mode(mode).partitionBy("year").parquet(path)


def save_tables(t: Tables, root: str) -> None:
    """All tables as `<root>/<table name>`, readable by `load_tables`."""
    save_entries(t.fact, f"{root}/main")
    for name, df in (
        ("project", t.project),
        ("projectstage", t.deadline),
        ("stage", t.stage),
        ("user", t.user),
    ):
        df.select(*SCHEMAS[name].fieldNames()).write.parquet(f"{root}/{name}")


def _years_of(rows: DataFrame, day: str = "dateStamp") -> list[int]:
    """The calendar years that occur: a bounded list."""
    return sorted(r[0] for r in rows.select(F.year(day)).distinct().collect())


def _written(spark: SparkSession, path: str) -> dict[int, str]:
    """The folders of a saved log by year; only folder names are read."""
    years = spark.read.schema(_YEARLY).parquet(path).select("year").distinct().collect()
    return {r.year: f"{path}/year={r.year}" for r in years}


def year_folders(spark: SparkSession, path: str) -> YearFolders:
    """A saved log as folders."""
    highest = spark.read.schema(FACT).parquet(path).agg(F.max("id")).first()[0]
    return YearFolders(_written(spark, path), (highest or 0) + 1)


def replace_years(
    spark: SparkSession, years: YearFolders, target: str, entries: DataFrame, touched: list[int],
    next_id: int | None = None, mode: str = "errorifexists",
) -> YearFolders:
    """`years` with all entries of the touched years replaced by `entries`, which are written
    to `target`; a year left without entries goes."""
    save_entries(entries, target, mode)
    kept = {y: f for y, f in years.folders.items() if y not in touched}
    return YearFolders(kept | _written(spark, target), next_id or years.next_id)


def publish_edits(
    spark: SparkSession, years: YearFolders, target: str, edits: DataFrame, mode: str = "errorifexists"
) -> Published:
    """The log with a batch of edits applied. Only the years of the batch are read, and
    written to `target`; the old folders stay as they are, so a failed write is repeated."""
    touched = _years_of(edits)
    low, high = edits.agg(F.min("seq"), F.max("seq")).first()
    outcome = apply_edits(years.entries(spark, touched), edits, F.lit(years.next_id))
    # New ids follow seq, see plans.ids.
    next_id = years.next_id + (high - low + 1 if touched else 0)
    after = replace_years(spark, years, target, outcome.entries, touched, next_id, mode)
    return Published(after, outcome.statuses)


def publish_without(
    spark: SparkSession, years: YearFolders, target: str, gone: DataFrame, key: str
) -> YearFolders:
    """The log without the entries of the users or projects in `gone` (`key`: userId or
    projectId). Only years that hold such entries are written."""
    lost = gone.select(F.col("id").alias(key)).distinct()
    touched = _years_of(years.entries(spark).join(lost, key, "left_semi"))
    left = years.entries(spark, touched).join(lost, key, "left_anti")
    return replace_years(spark, years, target, left, touched)
