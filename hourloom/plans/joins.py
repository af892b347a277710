"""Joins with a summary of the same rows, and with the list of stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on `keys` such that Spark's skew join can split a hot key, also where `right` is an
    aggregate by the same keys: a hash of them as one more key makes both sides shuffle anew."""
    extra = F.xxhash64(*keys).alias("_spread")
    return left.select("*", extra).join(right.select("*", extra), [*keys, "_spread"], how).drop("_spread")


def listed(stage: DataFrame) -> DataFrame:
    """Columns of the stage table, to join entries with. Stages are a short fixed list, so it goes
    to every task: dealt out by stage, all entries would lie in as many tasks as there are stages."""
    return F.broadcast(stage)
