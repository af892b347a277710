"""Op 11, hard-negative mining: windows of inner products over cover trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hourloom.llm import cover_tree
from hourloom.llm.common import keys128, stored, table

SAMPLE = 2048  # distinct vectors that centres and first bounds come from
CENTRES = 64  # of the top of the tree
BLOCK_BYTES = 32 << 20  # of vectors under one tree; a centre with more has several trees
ANCHORS = 4096  # that meet a block in one task, about

_FOUND = "anchor_id long, positive_id long, found_id long, score long"
_FOUND_ARROW = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "found_id", "score")])


def _one_row_per_id(rows: DataFrame) -> DataFrame:
    """Of rows that share an id, the one with the least label, then vector. Rows with an id
    of their own, normally all, do not shuffle for it."""
    shared = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    least = rows.join(shared, "id", "left_semi").groupBy("id")
    least = least.agg(F.min(F.struct("label", "vec")).alias("m")).select("id", "m.*")
    return rows.join(shared, "id", "left_anti").unionByName(least)


def _distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(label, vec, ids): equal vectors of a label have equal scores, so at most the `k` least
    ids of them can be in any answer; the limit applies before the shuffle too."""
    k1, k2 = keys128(F.col("vec"))
    keyed = rows.select("*", k1.alias("k1"), k2.alias("k2"))
    by_id = W.partitionBy("label", "k1", "k2").orderBy("id")
    first = keyed.withColumn("_n", F.row_number().over(by_id)).filter(F.col("_n") <= k)
    return first.groupBy("label", "k1", "k2").agg(
        F.first("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids")
    )


class _Top:
    """The top of the tree: centres from a bounded sample, with the angle that covers all rows
    nearest to them, and the sample itself, whose scores bound every answer from below."""

    def __init__(self, sample: list, dim: int, top: float):
        self.dim, self.norm = dim, top
        vectors = cover_tree.matrix(pa.array([r.vec for r in sample], pa.list_(pa.int64())), dim)
        self.labels = np.array([r.label for r in sample])
        self.ids = [list(r.ids) for r in sample]
        points = cover_tree.augmented(vectors, top)
        picked, _, _ = cover_tree.farthest_first(points, top, CENTRES, 0.0)
        self.points = points[picked]
        self.centres = vectors[picked].astype(np.float64)
        exact = top * top < cover_tree.EXACT
        self.vectors = vectors.astype(np.float64) if exact else vectors
        self.radii = np.zeros(len(picked))
        self.splits = [1] * len(picked)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = cover_tree.angles(cover_tree.augmented(rows, self.norm) @ self.points.T, self.norm**2)
        best = np.argmin(at, axis=1)
        return best, at[np.arange(len(rows)), best]

    def needs(self, query, allowed, own: int, low: list[int], high: list[int], k: int) -> list[int]:
        """Per window a score that `k` rows of the sample in it reach, if there are so many."""
        scores = self.vectors @ (query if self.vectors.dtype == np.int64 else query.astype(np.float64))
        out = []
        for lo, hi in zip(low, high):
            hits = np.flatnonzero(allowed & (scores >= lo) & (scores <= hi))
            hits = hits[np.argsort(-scores[hits], kind="stable")][: k + 1]
            many = np.cumsum([len(self.ids[i]) - (own in self.ids[i]) for i in hits])
            reach = np.searchsorted(many, k)
            out.append(int(scores[hits[reach]]) if reach < len(hits) else lo)
        return out

    def useful(self, query, low: list[int], high: list[int], need: list[int]) -> np.ndarray:
        """Centres whose rows may have a score that a window needs."""
        q = query.astype(np.float64)
        up, down = cover_tree.bounds(self.centres @ q, self.radii, float(np.sqrt(q @ q)) * self.norm)
        wants, tops = np.maximum(low, need).astype(np.float64), np.array(high, np.float64)
        hit = (up[:, None] >= wants) & (down[:, None] <= tops) & (wants <= tops)
        return np.flatnonzero(hit.any(axis=1))


def _spread(rows: DataFrame, k: int) -> tuple[DataFrame, _Top] | None:
    """Candidates dealt out to centres and blocks, and the top of their tree."""
    candidates = stored(_distinct_vectors(rows, k), "candidates")
    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    dim, square = candidates.agg(F.max(F.size("vec")), F.max(squares)).first()
    if dim is None:
        return None
    sample = candidates.orderBy("k1", "k2", "label").limit(SAMPLE).select("label", "vec", "ids").collect()
    top = _Top(sample, dim, float(np.sqrt(square)) * (1 + 1e-12))
    shipped = rows.sparkSession.sparkContext.broadcast(top)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shipped.value
        for b in batches:
            centre, angle = t.nearest(cover_tree.matrix(b.column("vec"), t.dim))
            b = b.append_column("centre", pa.array(centre, pa.int64()))
            yield b.append_column("angle", pa.array(angle, pa.float64()))

    schema = "label long, k1 long, vec array<bigint>, ids array<bigint>, centre long, angle double"
    dealt = candidates.select("label", "k1", "vec", "ids").mapInArrow(assign, schema)
    dealt = stored(dealt, "dealt")
    most = max(1, BLOCK_BYTES // (8 * max(dim, 1)))
    # At most one row per centre comes back.
    for r in dealt.groupBy("centre").agg(F.count("*").alias("n"), F.max("angle").alias("a")).collect():
        top.radii[r.centre] = r.a
        top.splits[r.centre] = -(-r.n // most)
    splits = F.element_at(F.array(*[F.lit(s).cast("long") for s in top.splits]), F.col("centre").cast("int") + 1)
    return dealt.select("label", "vec", "ids", "centre", F.pmod("k1", splits).alias("split")), top


def _searched(
    blocks: DataFrame, top: _Top, anchors: DataFrame, k: int, same_label: bool
) -> DataFrame:
    """For each anchor (id, label, vec) and each of its windows (arrays wid, low, high) the
    first `k` rows of every block in it, see cover_tree.search.

    Anchors go to the blocks that their bounds cannot rule out, in batches; a task holds one
    block's tree and one batch.
    """
    spark = anchors.sparkSession
    shipped = spark.sparkContext.broadcast(top)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shipped.value
        for b in batches:
            queries = cover_tree.matrix(b.column("vec"), t.dim)
            needs, useful = [], []
            rows = zip(queries, *[b.column(c).to_pylist() for c in ("id", "label", "low", "high")])
            for q, own, label, low, high in rows:
                allowed = (t.labels == label) == same_label
                needs.append(t.needs(q, allowed, own, low, high, k))
                useful.append(t.useful(q, low, high, needs[-1]).tolist())
            b = b.append_column("need", pa.array(needs, pa.list_(pa.int64())))
            yield b.append_column("centres", pa.array(useful, pa.list_(pa.int64())))

    schema = (
        "id long, label long, vec array<bigint>, wid array<bigint>, low array<bigint>, "
        "high array<bigint>, need array<bigint>, centres array<bigint>"
    )
    columns = ["id", "label", "vec", "wid", "low", "high"]
    routed = anchors.select(*columns).mapInArrow(route, schema)
    batches = max(1, -(-anchors.count() // ANCHORS))
    splits = F.element_at(F.array(*[F.lit(s).cast("long") for s in top.splits]), F.col("centre").cast("int") + 1)
    asked = (
        routed.select(*columns, "need", F.explode("centres").alias("centre"))
        .withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), splits - 1)))
        .withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches).cast("long")))
    )
    each = F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))
    dealt = blocks.select("*", F.explode(each).alias("batch"))
    key = ["centre", "split", "batch"]

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return _FOUND_ARROW.empty_table()
        t = shipped.value
        tree = cover_tree.CoverTree(cover_tree.matrix(rows.column("vec"), t.dim), t.norm)
        labels = rows.column("label").to_numpy()[tree.order]
        held = rows.column("ids").to_pylist()
        ids = cover_tree.Ids([held[i] for i in tree.order])
        # Queries have few windows each; the lists are filled up with empty ones.
        lists = {c: queries.column(c).to_pylist() for c in ("wid", "low", "high", "need")}
        wide = max(map(len, lists["wid"]))
        fill = {"wid": 0, "low": cover_tree.HIGHEST, "high": cover_tree.LOWEST, "need": 0}
        grid = {c: np.array([x + [fill[c]] * (wide - len(x)) for x in lists[c]], np.int64) for c in lists}
        own = queries.column("id").to_numpy()
        asked = queries.column("label").to_numpy()
        allowed = (asked[:, None] == labels) == same_label
        windows = cover_tree.Windows(grid["low"], grid["high"], grid["need"], k)
        vectors = cover_tree.matrix(queries.column("vec"), t.dim)
        q, w, score, found = cover_tree.search(tree, vectors, own, allowed, ids, windows)
        out = (own[q], grid["wid"][q, w], found, score)
        return pa.table([pa.array(c, pa.int64()) for c in out], schema=_FOUND_ARROW)

    return dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(meet, _FOUND)


def _first(found: DataFrame, key: list[str], k: int) -> DataFrame:
    best = W.partitionBy(*key).orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


_MINED = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
    "negative_score long"
)


def mine(
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vec_col: str = "vec",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of two integer vectors (array<bigint>; scores must fit a
    long). An anchor's positives are its `positives` best rows of the same label; for each of
    them the first `negatives` rows of other labels are returned whose score is from `low` to
    `high` percent of the positive's. Higher scores come first, ties by smaller id. The
    result is exact: bounds only leave out rows that cannot be in it.

    Rows with a null id, label, vector or component take no part. Of rows that share an id
    the one with the least label, then vector, counts; components a shorter vector lacks
    count as zero. Other columns play no part, whatever their names. No anchors, no
    positives or an empty window give no rows.
    """
    vec = F.col(f"`{vec_col}`")
    rows = df.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{label_col}`").cast("long").alias("label"),
        vec.alias("vec"),
        F.coalesce(is_anchor, F.lit(False)).alias("_anchor"),
    )
    whole = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
    rows = stored(rows.filter(whole & ~F.exists("vec", lambda x: x.isNull())), "vectors")
    anchor_ids = rows.filter("_anchor").select("id").distinct()
    rows = _one_row_per_id(rows.drop("_anchor"))
    spread = _spread(rows, max(positives + 1, negatives))
    if spread is None:
        return df.sparkSession.createDataFrame([], _MINED)
    blocks, top = spread
    anchors = stored(rows.join(anchor_ids, "id", "left_semi"), "anchors")

    all_scores = anchors.select(
        "*",
        F.array(F.lit(0).cast("long")).alias("wid"),
        F.array(F.lit(cover_tree.LOWEST)).alias("low"),
        F.array(F.lit(cover_tree.HIGHEST)).alias("high"),
    )
    found = _searched(blocks, top, all_scores, positives, same_label=True)
    best = stored(_first(found.drop("positive_id"), ["anchor_id"], positives), "positives")

    down = lambda a: f"(({a} * score) - pmod({a} * score, 100)) div 100"
    window = best.select(
        "anchor_id",
        F.col("found_id").alias("wid"),
        (-F.expr(down(-low))).alias("low"),
        F.expr(down(high)).alias("high"),
    )
    windows = window.groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("wid", "low", "high"))).alias("w")
    )
    windowed = anchors.join(windows, anchors.id == windows.anchor_id).select(
        "id", "label", "vec", F.col("w.wid"), F.col("w.low"), F.col("w.high")
    )
    found = _searched(blocks, top, stored(windowed, "windows"), negatives, same_label=False)
    mined = _first(found, ["anchor_id", "positive_id"], negatives)
    scored = best.select(
        "anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return mined.join(scored, ["anchor_id", "positive_id"]).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("found_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    usable = rows.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", bad))
    whole = usable.select(
        "vec_id",
        label.alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vec"),
    )
    return mine(whole, F.col("vec_id") % 100 == 0)
