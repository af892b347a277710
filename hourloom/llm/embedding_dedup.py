"""Op 6, embedding near-dedup by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm.common import spread_join, stored, table
from hourloom.llm.components import connected
from hourloom.llm.grouped import sorted_groups

MIN_COSINE = 0.95
WINDOW = 256  # neighbours that a row is compared with, in the order of a pass
RECALL = 0.99  # wanted at the threshold itself
BITS = 128  # of a concatenated hash
BLOCK = 128
STRETCHES = 8  # windows in a stretch of a pass, which is one group of rows in a task
CHUNK = 128  # rows compared with what follows them at once
CROWDED = 0.999  # share of rows that the number of passes is enough for


def agreement(min_cosine: float) -> float:
    """Chance that two vectors at the threshold agree in the sign of a random projection:
    1 - angle / pi, whatever the others are like."""
    return 1 - math.acos(max(-1.0, min(1.0, min_cosine))) / math.pi


def pass_count(bits: float, min_cosine: float, recall: float) -> int:
    """Passes after which a pair at the threshold has agreed in its first `bits` bits once,
    with chance `recall`."""
    meet = agreement(min_cosine) ** max(0.0, bits)
    return 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log(1 - meet))


def bits_needed(crowd: dict[int, int], share: float = CROWDED) -> int:
    """From rows by shared bits, the bits that suffice for `share` of the rows."""
    total, seen = sum(crowd.values()), 0
    for bits in sorted(crowd):
        seen += crowd[bits]
        if seen >= share * total:
            return bits
    return 0


def _matrix(column) -> np.ndarray:
    """Unit rows in double precision from a list column whose lists have one length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = values.reshape(len(flat), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _key_task(first: int, last: int, seed: int):
    """Per vector and pass, the concatenated signs of random projections as a byte string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                if dim not in planes:
                    rngs = [np.random.default_rng([seed, int(dim), p]) for p in range(first, last)]
                    planes[dim] = [r.standard_normal((int(dim), BITS)) for r in rngs]
                x = _matrix(part.column("vec"))
                for number, p in enumerate(planes[dim], first):
                    keys = np.packbits(x @ p > 0, axis=1)
                    raw = pa.Array.from_buffers(
                        pa.binary(BITS // 8), len(x), [None, pa.py_buffer(keys.tobytes())]
                    )
                    yield pa.RecordBatch.from_arrays(
                        [part.column("dim"), pa.array(np.full(len(x), number, np.int32)),
                         raw.cast(pa.binary()), part.column("node")],
                        names=["dim", "pass", "key", "node"],
                    )

    return run


def _in_order(keyed: DataFrame) -> DataFrame:
    """(place, dim, pass, key, node): rows in the order of length, pass and hash, numbered
    without a gap. The sorted ranges are written once, with the place of a row in its range;
    ranges are as many as partitions, and their sizes come to the driver."""
    order = ["dim", "pass", "key", "node"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "vector-order")
    part = F.shiftright("at", 33)
    sizes = sorted(tuple(r) for r in ranged.groupBy(part.alias("r")).agg(F.count("*")).collect())
    if not sizes:
        return ranged.withColumnRenamed("at", "place")
    before = accumulate((n for _, n in sizes), initial=0)
    starts = keyed.sparkSession.createDataFrame(
        [(r, b) for (r, _), b in zip(sizes, before)], "_range long, _before long"
    )
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ranged.withColumn("_range", part)
        .join(F.broadcast(starts), "_range")
        .select((F.col("_before") + inside).alias("place"), *order)
    )


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links, as pairs of positions."""
    label = np.arange(len(near))
    out = []
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        for j in np.flatnonzero(near[i] & (label != label[i])).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of keys, line by line."""
    differ = np.unpackbits(a ^ b, axis=1)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1])


def _window_task(min_cosine: float, window: int):
    """Compares each row of a stretch with the `window` rows after it in the same pass. Gives
    links enough to connect what is linked (kind 0), and how crowded it is (kind 1): rows by
    the bits a pair must share to be sure to meet in a window. Rows whose windows are mostly
    their own links are left out of that: copies of each other connect anyway."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, ["dim", "stretch"]):
            nodes, passes = rows.column("node").to_numpy(), rows.column("pass").to_numpy()
            # Rows of the stretch after this one are there to be compared with.
            own = int((~rows.column("halo").to_numpy(zero_copy_only=False)).sum())
            keys = rows.column("key").combine_chunks()
            flat = np.frombuffer(b"".join(keys.to_pylist()), np.uint8).reshape(len(rows), -1)
            x = _matrix(rows.column("vec"))
            links, crowd = [], np.zeros(BITS + 1, np.int64)
            for begin in range(0, own, CHUNK):
                end = min(begin + CHUNK, own)
                far = min(end + window, len(x))
                near = x[begin:end] @ x[begin:far].T >= min_cosine
                step = np.arange(far - begin) - np.arange(end - begin)[:, None]
                near &= (step > 0) & (step <= window) & (passes[begin:end, None] == passes[begin:far])
                if near.any():
                    square = np.zeros((far - begin, far - begin), bool)
                    square[: end - begin] = near
                    links += [(nodes[begin + i], nodes[begin + j]) for i, j in _forest(square | square.T)]
                at = np.arange(begin, end)
                # The row a window away is out of reach; what shares more bits than it is not.
                beyond = np.minimum(at + window + 1, len(x) - 1)
                full = (at + window + 1 < len(x)) & (passes[beyond] == passes[at])
                bits = np.where(full, _shared_bits(flat[at], flat[beyond]) + 1, 0)
                mostly = near.sum(axis=1) * 2 > window
                np.add.at(crowd, np.minimum(bits[~mostly], BITS), 1)
            seen = np.flatnonzero(crowd)
            u = np.concatenate([np.array([a for a, _ in links], np.int64), seen])
            v = np.concatenate([np.array([b for _, b in links], np.int64), crowd[seen]])
            kind = np.repeat(np.array([0, 1], np.int32), [len(links), len(seen)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(u), pa.array(v)], names=["kind", "u", "v"])

    return run


def _passes(classes: DataFrame, first: int, last: int, min_cosine: float, window: int, seed: int) -> DataFrame:
    """What the windows of some passes show, written once: (kind, u, v).

    A pass sorts hashes and ids only. Its order is cut into stretches of equal length, each
    with the first rows of the next one, so crowding makes no task larger, and vectors go to
    the stretches of their rows.
    """
    keyed = classes.select("node", "dim", "vec").mapInArrow(
        _key_task(first, last, seed), "dim int, pass int, key binary, node long"
    )
    size = window * STRETCHES
    stretch = F.floor(F.col("place") / size)
    ordered = _in_order(keyed).withColumn("own", stretch)
    # The row one beyond the window tells how crowded it is.
    halo = (F.col("place") % size <= window) & (F.col("own") > 0)
    copies = F.when(halo, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = ordered.withColumn("back", F.explode(copies)).select(
        "dim", "pass", "key", "node", "place",
        (F.col("own") - F.col("back")).alias("stretch"),
        (F.col("back") == 1).alias("halo"),
    )
    placed = dealt.join(classes.select("node", "vec"), "node")
    sorted_ = placed.repartition("dim", "stretch").sortWithinPartitions("dim", "stretch", "place")
    return stored(sorted_.mapInArrow(_window_task(min_cosine, window), "kind int, u long, v long"), "vector-windows")


def _degree_task(min_cosine: float):
    """All pairs of two blocks of a component, without giving out a pair: per node the weight
    of the nodes it is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["root", "a", "b"]):
            nodes = group.column("node").to_numpy()
            weight = group.column("weight").to_numpy().astype(np.float64)
            side = group.column("side").to_numpy()
            x = _matrix(group.column("vec"))
            a, b = int(group.column("a")[0].as_py()), int(group.column("b")[0].as_py())
            if a == b:
                linked = x @ x.T >= min_cosine
                np.fill_diagonal(linked, False)
                degree = linked @ weight
            else:
                left, right = np.flatnonzero(side == a), np.flatnonzero(side == b)
                linked = x[left] @ x[right].T >= min_cosine
                degree = np.zeros(len(nodes))
                degree[left] = linked @ weight[right]
                degree[right] = linked.T @ weight[left]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(degree.astype(np.int64))],
                names=["node", "degree"],
            )

    return run


def near_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    min_cosine: float = MIN_COSINE,
    window: int = WINDOW,
    recall: float = RECALL,
    seed: int = 7,
) -> DataFrame:
    """One row per row of `df`: id, `n_links`, `component_id`, `kept`.

    Equal vectors form one class, so copies never multiply pairs. Every pass orders the
    classes by their own concatenated random hashes (signs of projections, as byte strings)
    and compares each with the `window` that follow it, in double precision; the links of
    all passes are united into components. Inside a component all pairs are compared in
    blocks, which gives each vector its full number of links there, however dense the
    group. No link below `min_cosine` is counted.

    `recall` is the chance that a pair right at the threshold meets in a window. It agrees in
    its first b bits with a known chance; how many bits it takes until no more than a window
    of rows is left is measured on all rows of the first passes, and as many passes follow
    as the most crowded rows need (all but one in a thousand). So crowded directions cost
    passes, never links.

    Null or empty vectors, zero vectors and those with null or non-finite components link
    with nothing: they are components of their own. Vectors of different lengths do not link.
    A row with a null id takes part; `component_id` is the smallest id that is not null.
    Repeated ids and rows count each by themselves. Other columns are not read. No rows give
    no rows.
    """
    vec = F.col(f"`{vector_col}`")
    # Single precision is carried as it is, half the bytes; products are always in double.
    if df.schema[vector_col].dataType.simpleString() != "array<float>":
        vec = vec.cast("array<double>")
    bad = F.exists(
        vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    ) | ~F.exists(vec, lambda v: v != 0)
    good = vec.isNotNull() & ~F.coalesce(bad, F.lit(True))
    # x + 0.0 makes -0.0 and 0.0 one vector.
    node = F.xxhash64(F.size(vec), F.transform(vec, lambda v: v.cast("double") + F.lit(0.0)))
    rows = stored(
        df.select(
            F.col(f"`{id_col}`").alias("id"),
            F.when(good, node).alias("node"),
            F.when(good, vec).alias("vec"),
        ),
        "vectors",
    )
    valid = rows.filter("node IS NOT NULL")
    classes = stored(
        valid.groupBy("node")
        .agg(F.count("*").alias("weight"), F.first("vec").alias("vec"))
        .withColumn("dim", F.size("vec")),
        "vector-classes",
    )
    total = classes.count()
    even = math.log2(max(1.0, total / window))
    passes = pass_count(even, min_cosine, recall)
    seen = _passes(classes, 0, passes, min_cosine, window, seed)
    crowd = seen.filter("kind = 1").groupBy("u").agg(F.sum("v").alias("n")).collect()  # a row per bit
    wanted = pass_count(bits_needed({r.u: r.n for r in crowd}), min_cosine, recall)
    if wanted > passes:
        seen = seen.unionByName(_passes(classes, passes, wanted, min_cosine, window, seed))
    links = seen.filter("kind = 0").select("u", "v")
    comps = stored(connected(links, "vector-links"), "vector-components")
    sizes = comps.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = spread_join(comps, sizes, ["root"]).join(classes, "node")
    side = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int")
    placed = members.withColumn("side", side).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    placed = placed.select(
        "root", "node", "weight", "vec", "side",
        F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"),
    ).repartition("root", "a", "b").sortWithinPartitions("root", "a", "b")
    degrees = (
        placed.mapInArrow(_degree_task(min_cosine), "node long, degree long")
        .groupBy("node")
        .agg(F.sum("degree").alias("degree"))
    )
    facts = classes.select("node", "weight").join(comps, "node", "left").join(degrees, "node", "left")
    facts = facts.select(
        "node",
        F.coalesce("root", "node").alias("root"),
        (F.col("weight") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"),
    )
    known = stored(spread_join(valid.select("id", "node"), facts, ["node"]), "vector-rows")
    named = known.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = spread_join(known, named, ["root"]).select("id", "n_links", "component_id")
    alone = rows.filter("node IS NULL").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col),
        "n_links",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
