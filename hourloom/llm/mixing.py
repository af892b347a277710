"""Op 10, mixing sources to target weights with a low-discrepancy block schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourloom.llm.common import keys128, stored, table, whole

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 618033988749894848  # golden ratio's fraction, in units of 1e-18
UNIT = 10**18
POINTS = 10**9  # resolution of the cumulative shares
CELLS = 1024  # equi-join cells of the unit interval
SLOT_CHUNK = 512  # slots ranked together
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 16, 2048, 65_536

SOURCE = ["no_source", "source_key"]


def block_size(total: int) -> int:
    """Words of a block: about `BLOCKS` blocks, within fixed limits."""
    return max(LEAST_BLOCK, min(MOST_BLOCK, total // BLOCKS))


def _row_columns(df: DataFrame) -> list[Column]:
    """All columns, in a form that can be hashed: rows with equal keys are the same row."""
    maps = {f.name for f in df.schema if f.dataType.typeName() == "map"}
    return [F.map_entries(f"`{c}`") if c in maps else F.col(f"`{c}`") for c in df.columns]


def measured(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Narrow rows, one per document: keys, size in words and place in the shuffle. A null
    source is a source of its own, after all others."""
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`").cast("string")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    k1, k2 = keys128(*_row_columns(df))
    rows = df.select(
        F.col(f"`{id_col}`").alias("id"),
        source.isNull().alias("no_source"),
        F.coalesce(source, F.lit("")).alias("source_key"),
        F.regexp_count(whole(text), F.lit(WORD)).cast("long").alias("size"),
        F.md5(key).alias("shuffle"),
        k1.alias("k1"),
        k2.alias("k2"),
    )
    return stored(rows.withColumn("chunk", F.substring("shuffle", 1, 3)), "mixing")


def source_targets(rows: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source: its place by code point, weight, size, target and whole words wanted.

    All words are shared by weight; a target stops at `repeats` times its source's size and
    the excess is shared anew. In order of cap over weight the capped sources come first, so
    running sums give the common rate. One row per source: small, so the windows over all
    sources hold little.
    """
    sizes = rows.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(*SOURCE)) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("place", place).select(
        *SOURCE,
        "place",
        "source_size",
        F.element_at(cycle, F.col("place") % len(weights) + 1).cast("long").alias("weight"),
        (F.col("source_size") * repeats).alias("cap"),
    )
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    onward = by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rated = ranked.withColumn("rate", left.cast("double") / F.sum("weight").over(onward))
    rated = rated.withColumn("order", F.row_number().over(by_cap))
    capped = F.col("cap") <= F.col("rate") * F.col("weight")
    first = F.min(F.when(~capped, F.struct("order", "rate"))).over(everything)
    target = F.when(capped, F.col("cap").cast("double")).otherwise(
        F.col("common.rate") * F.col("weight")
    )
    targets = rated.withColumn("common", first).withColumn("target", target)
    wanted = targets.withColumn("wanted", F.floor("target").cast("long"))
    return wanted.select(*SOURCE, "place", "weight", "source_size", "target", "wanted")


def schedule(spark: SparkSession, sources: DataFrame, total: int, block: int) -> DataFrame:
    """(slot, place, block number): the mixed order of the sources' blocks.

    Slot i takes the golden-ratio point frac(i * phi), which falls into one source's part of
    the cumulative shares. A source's slots are ranked; rank r carries its block r. Ranks
    beyond its wanted words are left out, and missing ones follow in closing slots, so each
    source has exactly the blocks it needs. Points meet shares in an equi-join on cells.
    """
    slots = -(-total // block)
    ordered = W.orderBy("place")
    upto = F.sum("wanted").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))
    every = W.orderBy("place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    whole_sum = F.sum("wanted").over(every)
    dec = lambda c: c.cast("decimal(38,0)")
    shares = (
        sources.withColumn("upto", upto)
        .withColumn("all", whole_sum)
        .filter("wanted > 0")
        .withColumn("need", F.ceil(F.col("wanted") / block).cast("long"))
        .withColumn("hi", F.floor(dec(F.col("upto")) * POINTS / dec(F.col("all"))).cast("long"))
        .withColumn(
            "lo",
            F.floor(dec(F.col("upto") - F.col("wanted")) * POINTS / dec(F.col("all"))).cast("long"),
        )
    )
    width = -(-POINTS // CELLS)
    spans = shares.filter("hi > lo").select(
        "place", "lo", "hi", "need",
        F.explode(
            F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))
        ).alias("cell"),
    )
    point = F.floor((dec(F.col("id")) * GOLDEN) % UNIT / 10**9).cast("long")
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / width))
    hit = points.join(spans, "cell").filter("point >= lo AND point < hi")
    hit = hit.withColumn("part", F.floor(F.col("slot") / SLOT_CHUNK))
    parts = hit.groupBy("place", "part").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("place").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    rank = F.row_number().over(W.partitionBy("place", "part").orderBy("slot")) - 1
    ranked = (
        hit.withColumn("rank", rank)
        .join(parts.select("place", "part", "before"), ["place", "part"])
        .withColumn("block", F.col("before") + F.col("rank"))
    )
    counts = parts.groupBy("place").agg(F.sum("n").alias("have"))
    missing = (
        shares.join(counts, "place", "left")
        .withColumn("have", F.coalesce("have", F.lit(0)))
        .filter("have < need")
        .withColumn("block", F.explode(F.expr("sequence(have, need - 1)")))
        .withColumn("slot", F.lit(slots) + (F.col("block") - F.col("have")) * POINTS + F.col("place"))
    )
    used = ranked.filter(F.col("block") < F.col("need")).select("slot", "place", "block")
    return used.unionByName(missing.select("slot", "place", "block"))


def _starts(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds each document's place and first word in its source's shuffled stream, and its
    source's figures. Sums run over chunks of the shuffle key, so a hot source spreads."""
    chunk = rows.groupBy(*SOURCE, "chunk").agg(F.sum("size").alias("n"), F.count("*").alias("m"))
    earlier = W.partitionBy(*SOURCE).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = chunk.select(
        *SOURCE,
        "chunk",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("words_before"),
        F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("docs_before"),
    ).join(sources, SOURCE)
    inside = W.partitionBy(*SOURCE, "chunk").orderBy("shuffle", "id", "k1", "k2")
    sofar = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("words", F.sum("size").over(sofar)).withColumn(
        "docs", F.row_number().over(inside)
    )
    return (
        placed.join(offsets, [*SOURCE, "chunk"])
        .withColumn("start", F.col("words_before") + F.col("words") - F.col("size"))
        .withColumn("nth", F.col("docs_before") + F.col("docs"))
    )


def block_pieces(rows: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """Each document's pieces in its source's blocks: (place, nth, id, ..., block, words). The
    stream repeats up to the wanted words; a document no block takes has one null piece."""
    docs = _starts(rows, sources)
    rounds = F.ceil((F.col("wanted") - F.col("start")) / F.col("source_size")).cast("int")
    taken = (F.col("size") > 0) & (F.col("start") < F.col("wanted"))
    turns = F.when(taken, F.sequence(F.lit(0), rounds - 1))
    each = docs.withColumn("turn", F.explode_outer(turns))
    # A row that is not taken has null here, and in all that follows from it.
    begin = F.col("start") + F.col("turn") * F.col("source_size")
    each = each.withColumn("begin", begin).withColumn(
        "end", F.least(F.col("begin") + F.col("size"), "wanted")
    )
    spans = F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))
    each = each.withColumn("block", F.explode_outer(F.when(F.col("turn").isNotNull(), spans)))
    words = F.least("end", (F.col("block") + 1) * block) - F.greatest("begin", F.col("block") * block)
    return each.withColumn("words", words)


def occurrences(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    repeats: int = MAX_REPEATS,
    seed: int = 1,
    block_words: int | None = None,
) -> DataFrame:
    """One row per time the mix takes a row of `df`, and one with nulls for a row it does not
    take: keys and figures of the row, `turn`, `words` taken, and its place in the mix: the
    slot that carries the block with its first word, and the word's `offset` in the block."""
    rows = measured(df, id_col, text_col, source_col, seed)
    total = rows.agg(F.sum("size")).first()[0] or 0
    block = block_words or block_size(total)
    sources = source_targets(rows, weights, repeats)
    slots = schedule(df.sparkSession, sources, total, block)
    pieces = block_pieces(rows, sources, block)
    doc = ["place", "nth", "id", "size", "source_size", "target", "k1", "k2"]
    offset = F.greatest("begin", F.col("block") * block) - F.col("block") * block
    carried = pieces.select(*doc, "turn", "block", "words", offset.alias("offset")).join(
        slots, ["place", "block"], "left"
    )
    taken = F.when(F.col("slot").isNotNull(), F.col("words"))
    return carried.groupBy(*doc, "turn").agg(
        F.sum(taken).alias("words"),
        F.min_by("slot", "block").alias("slot"),
        F.min_by("offset", "block").alias("offset"),
    )


def mixing_plan(df: DataFrame, **options) -> DataFrame:
    """One row per row of `df`: `id`, `size`, `source_size`, `target`, `taken`, and where the
    mix takes it first, `first_slot` and `slot_offset` (null: nowhere). Options as
    `occurrences`.

    Size is the number of words; a null text has none. A null id shuffles as an empty one and
    a null source is the last source. Each source's documents are shuffled by a hash of seed
    and id, cut into blocks of equal words, and the schedule's slots take the blocks, wrapping
    round up to `repeats` times. So a source's taken words are its target's whole part, and a
    document gives at most `repeats` times its size. Documents without words give none; with
    no words at all every target is 0. Repeated rows count each by itself. The same rows and
    seed give the same result however they are partitioned. An empty table gives no rows.
    """
    doc = ["place", "nth", "id", "size", "source_size", "target", "k1", "k2"]
    return occurrences(df, **options).groupBy(*doc).agg(
        F.coalesce(F.sum("words"), F.lit(0)).alias("taken"),
        F.min_by("slot", "turn").alias("first_slot"),
        F.min_by("offset", "turn").alias("slot_offset"),
    )


def _first_words(text: Column, n: Column) -> Column:
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, n), " ")


def mix(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mixed table in the order of the schedule: (slot, offset, row), `row` a row of `df`
    with all its columns, as often as the plan takes it. A document stands where its first
    word stands, in the block that its source's turn in the schedule carries.

    A document taken whole k times occurs k times; the one document of a source where the
    target ends also occurs cut to its first words, joined by single spaces. Documents not
    taken are left out. Edge cases as `mixing_plan`; rows alike in every column are worked
    on together and occur as often as all of them are taken. Other columns pass unchanged,
    whatever their names.
    """
    taken = occurrences(df, text_col=text_col, **options).filter("words > 0")
    taken = taken.select("k1", "k2", F.col("size").cast("int"), F.col("words").cast("int"), "slot", "offset")
    k1, k2 = keys128(*_row_columns(df))
    packed = df.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2"))
    rows = packed.groupBy("k1", "k2").agg(F.first("row").alias("row")).join(taken, ["k1", "k2"])
    now = F.col("row")[text_col]
    cut = F.when(F.col("words") >= F.col("size"), now).otherwise(_first_words(now, F.col("words")))
    return rows.select(
        "slot", "offset", F.col("row").withField(f"`{text_col}`", cut).alias("row")
    ).orderBy("slot", "offset")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("long"),
        "first_slot", "slot_offset",
    )


# Contains the schedule: blocks as golden-ratio points deal them out, missing ones at the end.
OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, source, source IS NULL AS no_source, coalesce(source, '') AS source_key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle
  FROM documents),
s AS (
  SELECT no_source, source_key, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY no_source, source_key) - 1 AS place
  FROM d GROUP BY no_source, source_key),
w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight,
    source_size * {MAX_REPEATS} AS cap
  FROM s),
r AS (
  SELECT *, row_number() OVER c AS o,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum(weight) OVER (c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rate
  FROM w WINDOW c AS (ORDER BY CAST(cap AS DOUBLE) / weight, place)),
t AS (
  SELECT *, CASE WHEN cap <= rate * weight THEN CAST(cap AS DOUBLE)
    ELSE (SELECT arg_min(rate, o) FROM r WHERE cap > rate * weight) * weight END AS target
  FROM r),
v AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS wanted,
    CAST(sum(floor(target)) OVER (ORDER BY place) AS HUGEINT) AS upto,
    CAST(sum(floor(target)) OVER () AS HUGEINT) AS every
  FROM t),
b AS (
  SELECT greatest({LEAST_BLOCK}, least({MOST_BLOCK}, CAST(sum(size) AS BIGINT) // {BLOCKS})) AS block,
    CAST(sum(size) AS BIGINT) AS total
  FROM d),
share AS (
  SELECT place, CAST(ceil(wanted / block) AS BIGINT) AS need,
    CAST((upto - wanted) * {POINTS} // every AS BIGINT) AS lo, CAST(upto * {POINTS} // every AS BIGINT) AS hi
  FROM v, b WHERE wanted > 0),
point AS (
  SELECT slot, CAST(((CAST(slot AS HUGEINT) * {GOLDEN}) % {UNIT}) // 1000000000 AS BIGINT) AS point
  FROM b, range(CAST(ceil(total / block) AS BIGINT)) AS g(slot)),
hit AS (
  SELECT place, need, slot, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS block
  FROM point JOIN share ON point >= lo AND point < hi),
have AS (SELECT place, count(*) AS n FROM hit GROUP BY place),
slots AS (
  SELECT place, block, slot FROM hit WHERE block < need
  UNION ALL
  SELECT place, g.x, (SELECT CAST(ceil(total / block) AS BIGINT) FROM b) + (g.x - coalesce(n, 0)) * {POINTS} + place
  FROM share LEFT JOIN have USING (place), LATERAL (SELECT unnest(range(coalesce(n, 0), need)) AS x) AS g
  WHERE coalesce(n, 0) < need),
p AS (
  SELECT d.doc_id, d.size, v.source_size, v.target, v.wanted, v.place,
    CAST(sum(d.size) OVER (PARTITION BY d.no_source, d.source_key ORDER BY d.shuffle, d.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS a
  FROM d JOIN v USING (no_source, source_key)),
f AS (SELECT p.*, a // b.block AS first_block, a % b.block AS inside, size > 0 AND a < wanted AS used FROM p, b)
SELECT doc_id, size, source_size, target, CAST(
  greatest(0, least(a + size, wanted) - a)
  + greatest(0, least(a + source_size + size, wanted) - a - source_size)
  + greatest(0, least(a + 2 * source_size + size, wanted) - a - 2 * source_size) AS BIGINT) AS taken,
  CASE WHEN used THEN slots.slot END AS first_slot, CASE WHEN used THEN inside END AS slot_offset
FROM f LEFT JOIN slots ON slots.place = f.place AND slots.block = f.first_block
"""
