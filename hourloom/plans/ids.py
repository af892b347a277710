"""Ids for new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_id(table: DataFrame, key: str = "id") -> Column:
    """One above the highest id of a table, as a scalar subquery."""
    return table.agg((F.coalesce(F.max(key), F.lit(0)) + 1).alias("n")).scalar()


def arrival_ids(first: Column, seq: Column, lowest_seq: Column) -> Column:
    """Ids that follow arrival order. `seq` is unique in a batch, so the ids are too, and no
    row has to be counted; like an auto-increment column they may leave gaps."""
    return (first + seq - lowest_seq).cast("long")


def lowest(batch: DataFrame, key: str = "seq") -> Column:
    return batch.agg(F.coalesce(F.min(key), F.lit(0)).alias("n")).scalar()
