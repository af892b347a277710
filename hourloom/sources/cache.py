"""Materialised reports, keyed by operator, parameters and the content of what they read."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.schema import Tables


def fingerprint(df: DataFrame) -> str:
    """A text that tells the content of a table: the same for the same rows in any order or
    number of files, another one when a row changes, goes, or comes once more. Sums of two
    hashes of each row combine on the map side; one row is collected."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")) for seed in (1, 2)]
    got = df.agg(F.count(F.lit(1)), *sums).first()
    text = json.dumps([df.schema.simpleString(), *map(str, got)])
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def data_version(t: Tables) -> str:
    """Fingerprint of the five tables together."""
    parts = [fingerprint(df) for df in (t.fact, t.project, t.deadline, t.stage, t.user)]
    return hashlib.sha256("".join(parts).encode()).hexdigest()[:24]


def report_path(root: str, operator: str, params: dict, version: str) -> str:
    text = json.dumps(params, sort_keys=True, ensure_ascii=False, default=str)
    digest = hashlib.sha256(text.encode()).hexdigest()[:24]
    return f"{root}/reports/{operator}/{digest}/{version}"


def is_written(spark: SparkSession, path: str) -> bool:
    """True when the report in `path` was finished: its mark is written after it."""
    try:
        return not spark.read.schema("id long").parquet(f"{path}/done").isEmpty()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def materialised(
    spark: SparkSession,
    root: str,
    operator: str,
    params: dict,
    version: str,
    build: Callable[[], DataFrame],
) -> DataFrame:
    """Read the stored report, or build and store it first.

    `version` is the data_version of the tables, or the fingerprint of those that the report
    reads: changed data has a new path, so a stored report is never stale. An unfinished
    write is replaced.
    """
    path = report_path(root, operator, params, version)
    if not is_written(spark, path):
        build().write.mode("overwrite").parquet(f"{path}/rows")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/done")
    return spark.read.parquet(f"{path}/rows")
