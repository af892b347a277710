"""Calendar edits as a stream that lands in the log's year folders.

A micro-batch is applied by the batch operator, so a hot slot is spread as there, and its state
is the log itself. Batch n reads the folders that batch n - 1 left and writes its own; what it
leaves is recorded last. A batch that runs again after a failure starts from the same folders
and replaces its own output, so every edit counts once.

Inside a micro-batch edits apply in (ts, seq) order; an edit that comes in a later batch than
newer ones applies when it comes. Slots never time out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.schema import EDIT
from hourloom.session import fresh_dir
from hourloom.sources.snapshots import YearFolders, publish_edits

_YEARS = "year int, folder string, next_id long"
_START = -1  # number of the batch before the first one


def _record(spark: SparkSession, root: str, batch: int, years: YearFolders) -> None:
    """One small file per batch: the folder of each year."""
    rows = [(y, f, years.next_id) for y, f in sorted(years.folders.items())]
    found = spark.createDataFrame(rows or [(None, None, years.next_id)], _YEARS)
    found.coalesce(1).write.mode("overwrite").parquet(f"{root}/years/batch={batch}")


def years_after(spark: SparkSession, root: str, batch: int | None = None) -> YearFolders:
    """The log after a batch (by default the last one), from that batch's own record."""
    if batch is None:
        known = spark.read.schema(f"{_YEARS}, batch int").parquet(f"{root}/years")
        batch = known.agg(F.max("batch")).first()[0]
    rows = spark.read.schema(_YEARS).parquet(f"{root}/years/batch={batch}").collect()
    return YearFolders({r.year: r.folder for r in rows if r.year is not None}, rows[0].next_id)


def run_available(
    edits: DataFrame, root: str, checkpoint: str, start: YearFolders = YearFolders({})
) -> None:
    """Apply the edits that are there to the log and stop. `start` is the log that the first
    batch finds.

    A micro-batch takes all files that wait, unless the reader is told otherwise, and edits
    are ordered inside a batch only: the same files taken in other batches can end otherwise,
    as requests that arrive in another order do. Callers who need one order whatever the
    files give the reader files in that order, or one batch.
    """
    spark = edits.sparkSession
    _record(spark, root, _START, start)

    def apply(batch: DataFrame, number: int) -> None:
        held = fresh_dir(spark, "edit-batch")
        batch.select(*EDIT.fieldNames()).write.parquet(held)
        given = spark.read.schema(EDIT).parquet(held)
        before = years_after(spark, root, number - 1)
        done = publish_edits(spark, before, f"{root}/main/batch={number}", given, "overwrite")
        done.statuses.write.mode("overwrite").parquet(f"{root}/statuses/batch={number}")
        _record(spark, root, number, done.years)

    query = (
        edits.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_edits(
    spark: SparkSession, path: str, bytes_per_batch: int | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Edit stream from a folder of parquet files, without a bound on a batch unless given (a
    file is never split), see `run_available` on order."""
    reader = spark.readStream.schema(EDIT)
    if bytes_per_batch is not None:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def current_entries(spark: SparkSession, root: str, batch: int | None = None) -> DataFrame:
    """The log after a batch, by default the last one."""
    return years_after(spark, root, batch).entries(spark)


def edit_statuses(spark: SparkSession, root: str) -> DataFrame:
    """The fate of every edit so far: (seq, status)."""
    told = spark.read.schema("seq long, status string").parquet(f"{root}/statuses")
    return told.select("seq", "status")
