"""Op 9, near-duplicate documents by BagMinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm.common import kept_by_worker, keys128, spread_join, stored, table, whole
from hourloom.llm.components import connected
from hourloom.llm.grouped import sorted_groups

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5  # a pair at 0.8 shares no band with chance (1 - 0.8 ** 5) ** 24 < 1e-4
SLOTS = BANDS * ROWS
BLOCK_BYTES = 2_000_000  # text of a block of compared documents, about
BLOCK_ROWS = 1024  # documents of a block, about
BUCKET_ROWS = 16_384  # sketches of a band compared in one task, about half of them
MARGIN = 0.16  # below the threshold by so much, an estimate rules a pair out (over 4 sigma)
BATCH_BYTES = 1_000_000
MAX_TEXTS = 4096  # of a block; with HASH_BITS they share 64 bits
HASH_BITS = np.uint64(52)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GAMMA = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


# ------------------------------------------------------------- shingles


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64, kept by the worker."""

    def tables() -> tuple[np.ndarray, np.ndarray]:
        base = 0x9FB21C651E98DF25
        up = np.ones(size, np.uint64)
        down = np.ones(size, np.uint64)
        up[1:], down[1:] = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        return np.cumprod(up), np.cumprod(down)

    size = 1 << max(18, n.bit_length())
    return kept_by_worker("powers", size, tables)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte position of each white-space separated word of UTF-8 bytes; A-Z
    count as a-z. Prefix sums of a polynomial make it one pass however long the words."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    values = mix64(np.arange(1, 257, dtype=np.uint64) * GAMMA)
    values[65:91] = values[97:123]
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    words = (sums[end] - sums[begin]) * down[begin]
    return mix64(words ^ (end - begin).astype(np.uint64) * MIX2), begin


def bags(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multisets of the word shingles of texts that lie one behind the other in `data` with a
    blank after each: (text, shingle, count), sorted. A text of fewer words than a shingle
    has one shingle, all its words; one without words has none."""
    words, at = word_hashes(data)
    owner = np.searchsorted(ends, at, side="right")
    count = np.bincount(owner, minlength=len(ends))
    first = np.cumsum(count) - count
    shingles = np.maximum(count - SHINGLE + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(ends)), shingles)
    start = np.repeat(first - (np.cumsum(shingles) - shingles), shingles) + np.arange(shingles.sum())
    h = np.zeros(len(start), np.uint64)
    padded = np.append(words, np.zeros(SHINGLE, np.uint64))
    last = first[text] + count[text]
    for k in range(SHINGLE):
        w = np.where(start + k < last, padded[start + k], np.uint64(0))
        h = mix64(h * MIX1 + w + GAMMA)
    # Text and shingle in one number: its plain sort is many times faster than a sort by two.
    key = np.sort((text.astype(np.uint64) << HASH_BITS) | (h >> np.uint64(64 - HASH_BITS)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> HASH_BITS).astype(np.int64), key & ((np.uint64(1) << HASH_BITS) - np.uint64(1)), count


# ------------------------------------------------------------- signatures


def signatures(
    text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, slots: int = SLOTS
) -> np.ndarray:
    """BagMinHash signatures of multisets, `slots` values each; 0 for an empty one.

    Weights are discretised at the whole numbers. The unit levels below an element's weight
    are covered by intervals [0,1), [1,2), [2,4), [4,8), ...; each interval of an element is
    one Poisson process in time with the interval's length as its rate, seeded by element and
    interval only. A point has a slot and a level; points at levels beyond the weight do not
    count. So each unit level has its own process of rate one, shared by all documents, and
    a slot's first point agrees in two documents with the chance of their weighted Jaccard
    similarity. An interval stops once its time passes the document's last open slot, and an
    element of weight w costs log w intervals, not w levels.
    """
    levels = np.frexp(np.maximum(weight - 1, 0))[1] + 1  # intervals that cover [0, weight)
    stream = np.repeat(np.arange(len(text)), levels)
    k = np.arange(len(stream)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(k == 0, 0, 1 << np.maximum(k - 1, 0)).astype(np.float64)
    span = np.where(k == 0, 1, 1 << np.maximum(k - 1, 0)).astype(np.float64)
    doc, top = text[stream], weight[stream].astype(np.float64)
    state = mix64(element[stream] + mix64((k + 1).astype(np.uint64) * GAMMA))
    best = np.full(texts * slots, np.inf)
    value = np.zeros(texts * slots, np.uint64)
    limit = np.full(texts, np.inf)
    time = np.zeros(len(stream))
    unit = 2.0**-53
    while len(state):
        state = state + GAMMA
        draw = mix64(state)
        state = state + GAMMA
        place = mix64(state)
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * unit
        time = time - np.log(uniform) / span
        going = time <= limit[doc]
        state, doc, top, low, span, time, draw, place = (
            a[going] for a in (state, doc, top, low, span, time, draw, place)
        )
        level = low + span * ((place & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
        counts = level < top
        slot = (((place >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)).astype(np.int64)
        at = (doc * slots + slot)[counts]
        t, d = time[counts], draw[counts]
        np.minimum.at(best, at, t)
        won = best[at] == t
        value[at[won]] = d[won]
        limit = best.reshape(texts, slots).max(axis=1)
    return np.where(np.isfinite(best), value, np.uint64(0)).reshape(texts, slots)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band of each signature."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64)[None, :] * GAMMA + np.zeros((len(sig), 1), np.uint64)
    for r in range(ROWS):
        h = mix64(h * MIX1 + parts[:, :, r])
    return h


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(r + b" " for r in raw), np.uint8)
    return data, np.cumsum([len(r) + 1 for r in raw])


def _text_blocks(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    held, size, begin = [], 0, 0
    for i, t in enumerate(column):
        s = t.as_py() or ""
        if held and (size + len(s) > BATCH_BYTES or len(held) == MAX_TEXTS):
            yield begin, i, held
            held, size, begin = [], 0, i
        held.append(s)
        size += len(s)
    if held:
        yield begin, begin + len(held), held


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, bands, sketch); a text without words has no bands. The sketch
    has one byte of each signature value."""
    for batch in batches:
        for begin, end, texts in _text_blocks(batch.column("text")):
            data, ends = _joined(texts)
            text, shingle, count = bags(data, ends)
            sig = signatures(text, shingle, count, len(texts))
            h = band_hashes(sig)
            raw = (sig & np.uint64(255)).astype(np.uint8).tobytes()
            sketch = pa.Array.from_buffers(pa.binary(SLOTS), len(texts), [None, pa.py_buffer(raw)])
            has = np.bincount(text, minlength=len(texts)) > 0
            sizes = np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(sizes, pa.array(h[has].view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(begin, end - begin), bands, sketch.cast(pa.binary())],
                names=["node", "bands", "sketch"],
            )


# ------------------------------------------------------------- candidates


def _alike(similarity: float):
    """Links that connect what is similar by estimate in a band's bucket, or between two
    blocks of a large one. A byte agrees where the value does, so no pair that the whole
    signatures would let through is left out."""

    def links(sketch: np.ndarray, side: np.ndarray, cross: bool) -> list[tuple[int, int]]:
        label = np.arange(len(sketch))  # equal where connected
        out = []
        for i in range(len(sketch) - 1):
            apart = label[i + 1 :] != label[i]
            if cross:
                apart &= side[i + 1 :] != side[i]
            j = np.flatnonzero(apart) + i + 1
            hit = j[(sketch[j] == sketch[i]).mean(axis=1) >= similarity - MARGIN] if len(j) else j
            if len(hit):
                joined, at = np.unique(label[hit], return_index=True)
                out += [(i, k) for k in hit[at].tolist()]
                label[np.isin(label, joined)] = label[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["band", "a", "b"]):
            nodes = group.column("node").to_numpy()
            cross = group.column("a")[0].as_py() != group.column("b")[0].as_py()
            flat = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8)
            found = links(flat.reshape(len(nodes), -1), group.column("side").to_numpy(), cross)
            if found:
                u, v = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], names=["u", "v"])

    return run


def _candidates(signed: DataFrame, similarity: float) -> DataFrame:
    """(node, root): groups of documents that links by estimate connect, where only documents
    that share a band are compared. A text that many share only in part (a licence header)
    brings documents into one bucket, not into one group."""
    bands = signed.select("node", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    shared = buckets.filter("least <> most").select("band")
    members = stored(spread_join(bands, shared, ["band"]).distinct(), "near-buckets")
    blocks = F.ceil(F.count("*") / (BUCKET_ROWS / 2)).cast("int")
    large = members.groupBy("band").agg(blocks.alias("blocks")).filter("blocks > 2")
    wanted = members.select("node").distinct()
    sketches = signed.select("node", "sketch").join(wanted, "node", "left_semi").groupBy("node")
    sketches = sketches.agg(F.first("sketch").alias("sketch"))
    dealt = spread_join(members, large, ["band"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    side = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("side", side).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    placed = dealt.select(
        "band", "node", "side", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b")
    ).join(sketches, "node")
    order = ["band", "a", "b"]
    links = placed.repartition(*order).sortWithinPartitions(*order).mapInArrow(_alike(similarity), "u long, v long")
    return stored(connected(links, "near-groups"), "near-candidates")


# ------------------------------------------------------------- verification


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (sorted shingles, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return both / (a[1].sum() + b[1].sum() - both)


def _verified(similarity: float):
    """Links that connect what is similar in a block, or between two blocks, of a candidate
    group. Row by row, pairs that share a band and are not connected yet are taken by
    estimate, best first, and verified by their multisets at once. So a group of g copies of
    one text costs about g verifications, no more than one row's pairs are held, and no pair
    leaves the task but the links of a forest."""

    def links(nodes: list[int], side: np.ndarray, cross: bool, texts: list[str]):
        sigs, bag = [], []
        for at in range(0, len(texts), MAX_TEXTS):
            data, ends = _joined(texts[at : at + MAX_TEXTS])
            text, shingle, count = bags(data, ends)
            sigs.append(signatures(text, shingle, count, len(ends)))
            cut = np.searchsorted(text, np.arange(len(ends) + 1))
            bag += [(shingle[i:j], count[i:j]) for i, j in zip(cut, cut[1:])]
        sig = np.concatenate(sigs)
        band = band_hashes(sig)
        label = np.arange(len(texts))  # equal where connected
        out = []
        for i in range(len(texts) - 1):
            j = np.arange(i + 1, len(texts))
            apart = label[j] != label[i]
            if cross:
                apart &= side[j] != side[i]
            j = j[apart]
            agree = (sig[j] == sig[i]).mean(axis=1)
            near = (agree >= similarity - MARGIN) & (band[j] == band[i]).any(axis=1)
            order = np.argsort(-agree[near], kind="stable")
            for k in j[near][order].tolist():
                if label[k] != label[i] and overlap(bag[i], bag[k]) >= similarity:
                    label[label == label[k]] = label[i]
                    out.append((nodes[i], nodes[k]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["root", "a", "b"]):
            cross = group.column("a")[0].as_py() != group.column("b")[0].as_py()
            found = links(
                group.column("node").to_pylist(),
                group.column("side").to_numpy(),
                cross,
                group.column("text").to_pylist(),
            )
            if found:
                u, v = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"]
                )

    return run


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """One row per row of `df`: id, `class_id`, `class_size`, `kept`.

    Words are what white space separates, A-Z lower-cased; a document is the multiset of its
    shingles of five words (all its words if it has fewer). Documents whose multisets overlap
    by `similarity` or more are linked, and classes are what links connect. The document with
    the smallest id of a class is kept and names it.

    Equal texts (null counts as empty) are one node from the start, so copies cost nothing
    later; documents without words are near to nothing but their equals. Nodes that share a
    band of their BagMinHash signatures are compared by signature, in the band's bucket; what
    is similar by estimate forms candidate groups. These are compared block by block: a group of any size spreads over tasks, each with two blocks of about
    `BLOCK_BYTES` of text or `BLOCK_ROWS` documents, whichever is less, and links are verified on whole multisets.

    Null ids take part but never name a class that has another id; a class of null ids only
    has a null `class_id`. Rows that repeat an id and text count each, and are kept or not
    together. Other columns are not read; an empty table gives no rows.
    """
    k1, _ = keys128(whole(F.col(f"`{text_col}`")))
    docs = df.select(
        F.col(f"`{id_col}`").alias("id"), whole(F.col(f"`{text_col}`")).alias("text")
    ).withColumn("node", k1)
    rows = stored(docs.select("id", "node", F.octet_length("text").alias("bytes")), "near-rows")
    schema = "node long, bands array<long>, sketch binary"
    signed = stored(docs.select("node", "text").mapInArrow(_sign, schema), "near-bands")
    groups = _candidates(signed, similarity)
    # One row of each node carries its text: the first in the order of ids, then any.
    first = rows.groupBy("node").agg(F.min("id").alias("id"), F.max("bytes").alias("bytes"))
    members = spread_join(groups, first, ["node"])
    totals = members.groupBy("root").agg(
        F.ceil(
            F.greatest(F.sum("bytes") / BLOCK_BYTES, F.count("*") / BLOCK_ROWS)
        ).cast("int").alias("blocks")
    )
    members = spread_join(members, totals, ["root"]).select(
        "node", "root", "id", F.greatest("blocks", F.lit(1)).alias("blocks")
    )
    texts = docs.withColumnRenamed("node", "n").withColumnRenamed("id", "i")
    match = (F.col("n") == F.col("node")) & F.col("i").eqNullSafe(F.col("id"))
    carried = texts.join(members, match).dropDuplicates(["node"])
    side = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int")
    placed = carried.withColumn("side", side).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    placed = placed.select(
        "root", "node", "side", "text",
        F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"),
    ).repartition("root", "a", "b").sortWithinPartitions("root", "a", "b")
    links = placed.mapInArrow(_verified(similarity), "u long, v long")
    classes = stored(connected(links, "near-links"), "near-classes")
    named = spread_join(rows.select("id", "node"), classes, ["node"], "left").select(
        "id", F.coalesce("root", "node").alias("root")
    )
    named = stored(named, "near-named")
    sums = named.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return spread_join(named, sums, ["root"]).select(
        F.col("id").alias(id_col),
        "class_id",
        "class_size",
        F.col("id").eqNullSafe(F.col("class_id")).alias("kept"),
    )


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `df` that `near_duplicates` keeps, all columns as they were; rows of one id
    stay or go together. Rows with a null id stay only if their class has no other id."""
    kept = near_duplicates(df, id_col, text_col, **options).filter("kept")
    ids = kept.select(F.col(f"`{id_col}`").alias("kept_id")).distinct()
    packed = df.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"))
    stay = packed.join(ids, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    return stay.select("row.*")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
