"""Project spans of a year."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourloom.plans.periods import in_period
from hourloom.plans.predicates import relevance
from hourloom.schema import Tables
from hourloom.session import fresh_dir

# Fixed value: bar length shown for a span inside one month.
SHORT_SPAN = 0.2


def _positions(spans: DataFrame) -> DataFrame:
    """Adds the place `_pos` by name and start date, and the number `_n` of all spans. The
    range partitions are written once with their number, so that every later read sees the
    same ones; places inside a range are shifted by the rows of the ranges before it."""
    spark = spans.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_dir(spark, "gantt")
    ranged = spans.repartitionByRange(ranges, "name", "startdate")
    ranged = ranged.withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(path)
    stored = spark.read.schema(ranged.schema).parquet(path)
    # One row per range comes to the driver.
    counts = sorted(tuple(r) for r in stored.groupBy("_range").agg(F.count("*")).collect())
    upto = list(accumulate((n for _, n in counts), initial=0))
    each = spark.createDataFrame(
        [(part, before, upto[-1]) for (part, _), before in zip(counts, upto)],
        "_range int, _before long, _n long",
    )
    inside = W.partitionBy("_range").orderBy("name", "startdate")
    return (
        stored.withColumn("_inside", F.row_number().over(inside))
        .join(each, "_range")
        .withColumn("_pos", F.col("_before") + F.col("_inside"))
    )


def gantt_spans(t: Tables, year: int, relevant: bool | int | None = None) -> DataFrame:
    """(name, start_m, end_m, span, pos): first and last month with entries in the year, the
    bar length, and the even position 0..1 of the project in name order."""
    active = (
        t.fact.filter(in_period(F.col("dateStamp"), year))
        .groupBy(F.year("dateStamp").alias("year"), "projectId")
        .agg(F.min("dateStamp").alias("_first"), F.max("dateStamp").alias("_last"))
    )
    projects = t.project
    if relevant is not None:
        projects = projects.filter(relevance(relevant))
    spans = (
        active.join(projects.select("id", "name", "startdate"), F.col("projectId") == F.col("id"))
        .groupBy("year", "name", "startdate")
        .agg(F.month(F.min("_first")).alias("start_m"), F.month(F.max("_last")).alias("end_m"))
    )
    placed = _positions(spans)
    months = F.col("end_m") - F.col("start_m")
    return placed.select(
        "name",
        "start_m",
        "end_m",
        F.when(months == 0, F.lit(SHORT_SPAN)).otherwise(months.cast("double")).alias("span"),
        ((F.col("_pos") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).alias("pos"),
    )
