"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.session import fresh_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read again: computed once, lineage cut, and safe
    when executors are lost."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole(text: Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def keys128(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns: together a 128-bit key."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(77), *columns)]


def kept_by_worker(kind: str, key, build: Callable):
    """What `build` makes, once per Python worker as long as `kind` and `key` stay the same;
    what was kept before goes first, so a worker holds one thing only. Task functions travel
    by value, so their own globals do not outlive a task."""
    home = sys.modules.setdefault("_hourloom_worker_cache", types.ModuleType("cache"))
    entries = home.__dict__.setdefault("entries", {})
    if (kind, key) not in entries:
        entries.clear()
        entries[kind, key] = build()
    return entries[kind, key]


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on `keys` such that Spark's skew join can split a hot key, also where `right` is an
    aggregate by the same keys: the hash as one more key makes both sides shuffle anew."""
    extra = F.xxhash64(*[F.col(k) for k in keys]).alias("_spread")
    joined = left.select("*", extra).join(right.select("*", extra), [*keys, "_spread"], how)
    return joined.drop("_spread")
