"""Op 2, exact dedup: two-pass Bloom filtering, then exact groups of the possible repeats."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm.common import ascii_lower, spread_join, stored, table, whole
from hourloom.session import fresh_dir

BITMAP_BITS = 32_768  # of one bitmap of bitmap_construct_agg
MAX_FILTER_BITS = 1 << 30  # 128 MB, the bound of a filter that is broadcast
CELLS_PER_ROW = 16


def filter_shape(rows: int, max_bits: int = MAX_FILTER_BITS) -> tuple[int, int]:
    """Cells of a filter and number of filters for so many rows, both powers of two. A filter
    has at most `max_bits` cells; more rows are split by a hash into as many slices as give
    each its own filter of `CELLS_PER_ROW` cells a row."""
    wanted = max(BITMAP_BITS, 1 << math.ceil(math.log2(max(rows, 1) * CELLS_PER_ROW)))
    cells = min(wanted, max(BITMAP_BITS, 1 << int(math.log2(max_bits))))
    return cells, wanted // cells


def _cell(h: Column, which: int, cells: int) -> Column:
    """One of the two filter cells of a hash."""
    return (F.shiftrightunsigned(h, 32) if which else h).bitwiseAND(cells - 1)


def _bitmaps(cell_rows: DataFrame) -> DataFrame:
    """The set cells (`cell`) as (bucket, bits), written: a filter is read more than once."""
    position = (F.col("cell") % BITMAP_BITS).cast("long")
    bucket = F.floor(F.col("cell") / BITMAP_BITS).cast("long").alias("bucket")
    return stored(
        cell_rows.groupBy(bucket).agg(F.bitmap_construct_agg(position).alias("bits")), "exact-filter"
    )


def repeated_cells(hashes: DataFrame, which: int, cells: int) -> DataFrame:
    """The Bloom filter of what occurs more than once: a cell is set if two rows or more fall
    into it. One cell a row is counted, first on the map side."""
    each = hashes.select(_cell(F.col("h"), which, cells).alias("cell"))
    return _bitmaps(each.groupBy("cell").agg(F.count("*").alias("n")).filter("n >= 2"))


def _is_set(bits: Column, cell: Column) -> Column:
    place = cell % BITMAP_BITS
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10)
    bit = F.floor(byte.cast("int") / F.pow(F.lit(2), place % 8)) % 2
    return F.coalesce(bit == 1, F.lit(False))


def in_filter(rows: DataFrame, bitmaps: DataFrame, which: int, cells: int, name: str) -> DataFrame:
    """Adds `name`, true where the cell of `h` is set. A filter has at most `MAX_FILTER_BITS`
    bits, so it is broadcast; the rows stay where they are."""
    side = bitmaps.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    rows = rows.withColumn("_cell", _cell(F.col("h"), which, cells))
    joined = rows.join(
        F.broadcast(side), F.floor(F.col("_cell") / BITMAP_BITS) == F.col("_bucket"), "left"
    )
    found = _is_set(F.col("_bits"), F.col("_cell"))
    return joined.withColumn(name, found).drop("_bucket", "_bits", "_cell")


def _maybe_repeated(rows: DataFrame, cells: int) -> DataFrame:
    """Adds `maybe` by two passes: the first filter holds one cell of every row, the second
    the other cell of the rows that the first lets through. Rows of one hash share both."""
    once = in_filter(rows, repeated_cells(rows, 0, cells), 0, cells, "_first")
    second = repeated_cells(once.filter("_first"), 1, cells)
    twice = in_filter(once, second, 1, cells, "_second")
    return twice.withColumn("maybe", F.col("_first") & F.col("_second")).drop("_first", "_second")


def maybe_repeated(rows: DataFrame, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """`rows` (written, with a hash `h`) and `maybe`: false only where no other row has the same
    hash. Where one filter would be too large, the rows are first written in a folder per
    slice of the hashes, which moves none of them, and the slices take their turns."""
    cells, slices = filter_shape(rows.count(), max_filter_bits)
    if slices == 1:
        return _maybe_repeated(rows, cells)
    spark, bits = rows.sparkSession, slices.bit_length() - 1
    path, out = fresh_dir(spark, "exact-slices"), fresh_dir(spark, "exact-marked")
    slice_ = F.shiftrightunsigned(F.xxhash64("h"), 64 - bits)
    rows.withColumn("slice", slice_).write.partitionBy("slice").parquet(path)
    every = spark.read.schema(f"{_ddl(rows)}, slice long").parquet(path)
    for i in range(slices):
        marked = _maybe_repeated(every.filter(F.col("slice") == i).drop("slice"), cells)
        marked.write.parquet(f"{out}/slice={i}")
    return spark.read.schema(f"{_ddl(rows)}, maybe boolean").parquet(out)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _groups(maybe: DataFrame) -> DataFrame:
    """(sha, h, keep_id, group_size) of the possible repeats; partial counts come first."""
    return maybe.groupBy("sha").agg(
        F.first("h").alias("h"), F.max("id").alias("keep_id"), F.count("*").alias("group_size")
    )


def exact_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_filter_bits: int = MAX_FILTER_BITS,
) -> DataFrame:
    """One row per row of `df`: id, `keep_id`, `group_size`, `kept`, `text_sha256`.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and
    empty texts are one group. The largest id of a group stays. A null id is below all
    others: it stays only where its group has no other, and `keep_id` is null then. Rows that
    repeat both text and id share their result. An empty table gives an empty result. Only
    the two named columns are read, so other columns cannot clash.

    The text is scanned once, for a hash and its SHA-256. Rows the filter clears never
    shuffle; possible repeats are grouped by SHA-256 (partial counts first) and joined with
    their groups, a hot group being split by Spark's skew join.
    """
    norm = ascii_lower(whole(F.col(f"`{text_col}`")))
    scan = df.select(F.col(f"`{id_col}`").alias("id"), norm.alias("norm"))
    rows = stored(
        scan.select("id", F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("sha")),
        "exact-dedup",
    )
    marked = maybe_repeated(rows, max_filter_bits)
    single = marked.filter(~F.col("maybe")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha"
    )
    maybe = marked.filter("maybe").select("id", "sha")
    groups = _groups(marked.filter("maybe")).drop("h")
    grouped = spread_join(maybe, groups, ["sha"]).select("id", "keep_id", "group_size", "sha")
    return single.unionByName(grouped).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_filter_bits: int = MAX_FILTER_BITS,
) -> DataFrame:
    """The rows of `df` that stay, all columns as they were. Edge cases as `exact_groups`.

    The repeats are found on narrow rows as in `exact_groups`. A filter of their hashes, one
    for all slices, then lets all other whole rows pass straight through; rows in it shuffle,
    and a row goes if its text's group keeps another id. With more repeated texts than
    `max_filter_bits` has room for, more rows shuffle; the result does not change.
    """
    norm = ascii_lower(whole(F.col(f"`{text_col}`")))
    packed = df.select(
        F.struct("*").alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(norm).alias("h"),
        norm.alias("norm"),
    ).select("row", "id", "h", F.sha2("norm", 256).alias("sha"))
    narrow = stored(packed.drop("row"), "exact-dedup-hashes")
    groups = _groups(maybe_repeated(narrow, max_filter_bits).filter("maybe"))
    groups = stored(groups.filter("group_size >= 2"), "exact-dedup-groups")
    cells, _ = filter_shape(groups.count(), max_filter_bits)
    repeats = _bitmaps(groups.select(_cell(F.col("h"), 0, cells).alias("cell")))
    marked = in_filter(packed, repeats, 0, cells, "maybe")
    keep = groups.select("sha", "keep_id", F.lit(True).alias("grouped"))
    seen = spread_join(marked.filter("maybe"), keep, ["sha"], "left")
    stay = seen.filter(F.col("grouped").isNull() | F.col("id").eqNullSafe(F.col("keep_id")))
    return marked.filter(~F.col("maybe")).select("row").unionByName(stay.select("row")).select("row.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
