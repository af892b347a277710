"""Op 8, sharding: contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourloom.llm.common import stored, table, whole

SHARDS = 40
ROW_BYTES = 16
WHOLE_GROUP = 50  # copies that take at most this fraction of a shard are not cut apart


def shard_rows(
    df: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: bool = True,
) -> DataFrame:
    """One row per row of `df`: `id`, `size`, `text_crc32`, `shard`, `slot`, and with `keep`
    the whole row as a struct `row`.

    Law `bytes`: a row's size is the UTF-8 bytes of its text (null: none) plus 16. Rows stand
    in one global order, by a hash of the text, then id, so copies of a text are neighbours
    and shards are mixed. A row goes to the shard its middle byte falls into when the bytes
    of all rows are cut at equal targets. Where a cut falls into copies of a text that take
    at most 1/50 of a shard, it moves to their nearer end. So a shard's end is off by less
    than one row or 1/100 of a shard, and only larger groups of copies are cut apart.
    `slot` is the row's position in its shard, from 0.

    Null ids come first among copies; rows equal in id and text are interchangeable. With
    fewer rows than shards some shards are empty; an empty table gives no rows. Range
    partitions split a hot text by id; their totals (one row per partition) give each its
    offset. The partitions are written once, so every later read sees the same ones.
    """
    text = whole(F.col(f"`{text_col}`"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = df.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        *([F.struct("*").alias("row")] if keep else []),
    )
    ranged = stored(
        narrow.repartitionByRange(ranges, "h", "id").withColumn("part", F.spark_partition_id()),
        "shard-ranges",
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # One row per range partition from here to `offsets`.
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every).alias("total"),
    )
    inside = W.partitionBy("part").orderBy("h", "id")
    placed = ranged.withColumn(
        "upto", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    ).withColumn("nth", F.row_number().over(inside) - 1)
    placed = placed.join(offsets, "part")
    middle = "2 * (bytes_before + upto - size) + size"
    shard = F.expr(f"int((({middle}) * {int(shards)}) div (2 * total))")
    cut = placed.withColumn("shard", shard)
    cut = cut.withColumn("position", F.col("rows_before") + F.col("nth"))
    cut = _uncut_groups(cut, int(shards))
    # One row per shard: `shards` bounds what is broadcast.
    first = cut.groupBy("shard").agg(F.min("position").alias("first"))
    out = cut.join(F.broadcast(first), "shard").withColumn("slot", F.col("position") - F.col("first"))
    return out.select("id", "size", "text_crc32", "shard", "slot", *(["row"] if keep else []))


def _uncut_groups(cut: DataFrame, shards: int) -> DataFrame:
    """`cut` with each small group of copies (equal `h`) in the shard of its middle byte. At
    most one group lies across each cut, so `shards` bounds the groups that are looked at."""
    ends = cut.groupBy("shard").agg(
        F.min_by("h", "position").alias("first_h"), F.max_by("h", "position").alias("last_h")
    )
    before = ends.select(F.col("shard").alias("earlier"), F.col("last_h").alias("h"))
    after = ends.select(F.col("shard").alias("later"), F.col("first_h").alias("h"))
    across = before.join(after, "h").filter("earlier < later").select("h").distinct()
    groups = cut.join(F.broadcast(across), "h").groupBy("h").agg(
        F.min(F.col("bytes_before") + F.col("upto") - F.col("size")).alias("start"),
        F.sum("size").alias("bytes"),
        F.first("total").alias("total"),
    )
    small = groups.filter(F.col("bytes") * shards * WHOLE_GROUP <= F.col("total"))
    home = small.select("h", F.expr(f"int(((2 * start + bytes) * {shards}) div (2 * total))").alias("home"))
    moved = cut.join(F.broadcast(home), "h", "left")
    return moved.withColumn("shard", F.coalesce("home", "shard")).drop("home")


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, **columns: str) -> DataFrame:
    """Writes the rows of `df`, all columns kept in a struct `row`, to `path` in one folder
    per shard, each file sorted by slot (range partitions: files follow each other by slot), and returns what was written."""
    rows = shard_rows(df, shards, **columns)
    rows = rows.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(table(spark, sf_dir, "documents"), keep=False)
    return rows.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
