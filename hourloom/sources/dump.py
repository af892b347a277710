"""Ingest of SQL dump text: multi-row INSERT statements to typed tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hourloom.schema import SCHEMAS, Tables
from hourloom.session import fresh_dir

_HEADER = r"^\s*INSERT INTO\s+`?(\w+)`?\s*\(([^)]*)\)\s*VALUES"
# A quoted text, with doubled quotes and backslash escapes.
_QUOTED = r"'[^'\\]*+(?:(?:''|\\.)[^'\\]*+)*+'"
_TUPLE = rf"(\((?:[^'()]++|{_QUOTED})*+\))"
_VALUE = rf"({_QUOTED}|[^\s,()']+)"


def _carried_down(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """From (split, event) of the lines of a scan task, in order: the last event before each
    line in its split. Only the state of one line lasts from batch to batch."""
    split, last = None, None
    for splits, events in batches:
        out = []
        for at, event in zip(splits.to_pylist(), events.to_pylist()):
            if at != split:
                split, last = at, None
            out.append(last)
            if event is not None:
                last = event
        yield pa.array(out, pa.string())


def _left_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (file, block, event) of the lines of a scan task, in order: one row per split with
    its last event."""
    split, last, rows = None, None, []
    for batch in batches:
        for file, block, event in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != split:
                if split is not None:
                    rows.append((*split, last))
                split, last = (file, block), None
            if event is not None:
                last = event
    if split is not None:
        rows.append((*split, last))
    columns = list(zip(*rows)) or [(), (), ()]
    arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.string()))]
    yield pa.RecordBatch.from_arrays(arrays, names=["file", "block", "_left_open"])


def statement_lines(spark: SparkSession, path: str) -> DataFrame:
    """(table, columns, line) for each line that carries row tuples.

    Tuples may follow their INSERT header many lines later, in another input split. The
    header in force at the start of each split is worked out from one row per split; inside
    a split it is carried down as the lines are read. Lines are neither moved nor sorted, and
    no task holds a split.
    """
    lines = spark.read.text(path).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    header = F.when(F.col("value").rlike(_HEADER), F.regexp_extract("value", _HEADER, 0))
    # An empty text marks that no statement is open.
    ends = F.col("value").rlike(r";\s*$")
    event = F.when(ends, F.lit("")).otherwise(header)
    marked = lines.withColumn("_open", header).withColumn("_event", event)
    events = marked.select("file", "block", "_event")
    per_block = events.mapInArrow(_left_open, "file string, block long, _left_open string")
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = per_block.select(
        "file", "block", F.last("_left_open", ignorenulls=True).over(earlier).alias("_carried")
    )
    # Not deterministic, so that no filter comes between the scan and it.
    carry = F.arrow_udf(_carried_down, "string").asNondeterministic()
    split = F.xxhash64("file", "block")
    before = marked.withColumn("_before", carry(split, "_event"))
    # One row per split.
    placed = before.join(F.broadcast(carried), ["file", "block"])
    statement = F.coalesce("_open", "_before", "_carried")
    rows = placed.withColumn("_statement", statement).filter(
        F.col("_statement").isNotNull() & (F.col("_statement") != "")
    )
    names = F.split(F.regexp_replace(F.regexp_extract("_statement", _HEADER, 2), r"[`\s]", ""), ",")
    return rows.select(
        F.regexp_extract("_statement", _HEADER, 1).alias("table"),
        names.alias("columns"),
        F.regexp_replace("value", _HEADER, "").alias("line"),
    )


def _unquoted(value: Column) -> Column:
    """Text of a literal: NULL, a number, or a quoted text with its escapes undone."""
    body = F.substring(value, F.lit(2), F.length(value) - 2)
    # Escaped backslashes step aside so that they shield nothing after them.
    held = F.replace(body, F.lit("\\\\"), F.lit("\u0000"))
    for escaped, plain in (("''", "'"), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r")):
        held = F.replace(held, F.lit(escaped), F.lit(plain))
    plain_text = F.replace(F.regexp_replace(held, r"\\(.)", "$1"), F.lit("\u0000"), F.lit("\\"))
    return F.when(F.startswith(value, F.lit("'")), plain_text).when(F.upper(value) != "NULL", value)


def dump_table(spark: SparkSession, path: str, name: str, lines: DataFrame | None = None) -> DataFrame:
    """Rows of one table, typed by its schema. Columns outside the schema (such as the login
    secret) are dropped; a text that does not fit its type is NULL, for the audit to count."""
    lines = statement_lines(spark, path) if lines is None else lines
    tuples = lines.filter(F.col("table") == name).select(
        "columns", F.explode(F.regexp_extract_all("line", F.lit(_TUPLE), F.lit(1))).alias("tuple")
    )
    valued = tuples.select(
        F.map_from_arrays("columns", F.regexp_extract_all("tuple", F.lit(_VALUE), F.lit(1))).alias("v")
    )
    return valued.select(
        *[
            _unquoted(F.try_element_at("v", F.lit(f.name))).try_cast(f.dataType).alias(f.name)
            for f in SCHEMAS[name]
        ]
    )


def load_dump(spark: SparkSession, path: str) -> Tables:
    lines = statement_lines(spark, path)
    return Tables(
        fact=dump_table(spark, path, "main", lines),
        project=dump_table(spark, path, "project", lines),
        deadline=dump_table(spark, path, "projectstage", lines),
        stage=dump_table(spark, path, "stage", lines),
        user=dump_table(spark, path, "user", lines),
    )


def ingest_dump(spark: SparkSession, path: str, root: str) -> None:
    """Write the dump's tables as `<root>/<table>` parquet. The text is taken apart once, into
    lines in the shared folder, in the order of the dump, from which each table is read: the
    row groups of other tables are passed over by their statistics."""
    split = fresh_dir(spark, "dump-lines")
    lines = statement_lines(spark, path).filter(F.col("table").isin(*SCHEMAS))
    lines.write.parquet(split)
    stored = spark.read.schema(lines.schema).parquet(split)
    for name in SCHEMAS:
        dump_table(spark, path, name, stored).write.mode("errorifexists").parquet(f"{root}/{name}")
