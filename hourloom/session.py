"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", name: str = "hourloom", **extra: str) -> SparkSession:
    """A single-machine session for tests and the bench, with a temporary folder as its
    `spark.checkpoint.dir`; clusters bring their own session and folder."""
    conf = {
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="hourloom-"),
        "spark.sql.shuffle.partitions": str(cpus) if cpus != "*" else "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **extra,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's `spark.checkpoint.dir`."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return configured.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
