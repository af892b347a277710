"""Op 11 and its cover tree against scoring every row."""

import math
import random

import numpy as np
import pytest

from hourloom.llm import cover_tree, hard_negatives, queries

SF = "/root/testdata/sf0.001"


def by_hand(rows, anchors, positives=5, negatives=10):
    """Rows are (id, label, vector of ints); ids are unique."""
    out = set()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for own, label, vec in rows:
        if own not in anchors:
            continue
        scored = sorted((-dot(vec, v), i, other) for i, other, v in rows if i != own)
        for minus, positive, _ in [s for s in scored if s[2] == label][:positives]:
            p = -minus
            fits = [(s, i) for s, i, other in scored if other != label and 30 * p <= -100 * s <= 90 * p]
            for rank, (s, i) in enumerate(fits[:negatives], 1):
                out.add((own, positive, rank, i, p, -s))
    return out


def contract_rows(raw):
    rows = []
    for vec_id, vec, label in raw:
        if vec_id is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        rows.append((vec_id, label, [math.floor(256 * x) for x in vec]))
    return rows


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def answers(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_op11_on_a_given_table(spark):
    raw = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rows = contract_rows(raw)
    want = by_hand(rows, {r[0] for r in rows if r[0] % 100 == 0})
    assert want and answers(queries.QUERIES["op11_hard_negatives"](spark, SF)) == want


def clustered(rng, n, dim, spread):
    centres = rng.normal(size=(6, dim))
    picked = centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dim))
    return np.floor(64 * picked).astype(np.int64)


@pytest.mark.parametrize("spread", [0.05, 3.0])
@pytest.mark.parametrize("factor", [1, 10**6])
def test_tree_answers_windows(spread, factor):
    """Small and large numbers (beyond 2^52 sums are taken in integers), copies among the rows."""
    rng = np.random.default_rng(4)
    rows = clustered(rng, 900, 12, spread) * factor
    rows[100:300] = rows[0]
    top = float(np.sqrt((rows.astype(float) ** 2).sum(axis=1).max())) * (1 + 1e-12)
    tree = cover_tree.CoverTree(rows, top)
    assert sorted(tree.order.tolist()) == list(range(len(rows)))
    labels = rng.integers(0, 3, len(rows))
    ids = cover_tree.Ids([[int(i)] for i in tree.order])
    queries = rows[::90]
    scores = [[sum(int(a) * int(b) for a, b in zip(q, r)) for r in rows] for q in queries]
    best = np.array([max(s) for s in scores])
    none = np.full(len(queries), cover_tree.LOWEST)
    low = np.stack([none, best // 3, -best, best], axis=1)
    high = np.stack([np.full(len(queries), cover_tree.HIGHEST), best // 2, best // 9, best - 1], axis=1)
    allowed = np.tile(labels[tree.order] == 1, (len(queries), 1))
    windows = cover_tree.Windows(low, high, low, 7)
    got = cover_tree.search(tree, queries, np.full(len(queries), 5), allowed, ids, windows)
    found = {}
    for q, w, s, i in zip(*map(np.ndarray.tolist, got)):
        found.setdefault((q, w), []).append((-s, i))
    for n, line in enumerate(scores):
        for w in range(4):
            fits = [(-s, i) for i, s in enumerate(line) if low[n, w] <= s <= high[n, w] and labels[i] == 1 and i != 5]
            assert found.get((n, w), []) == sorted(fits)[:7]


def test_every_node_covers_its_rows():
    rng = np.random.default_rng(8)
    rows = clustered(rng, 2000, 8, 0.3)
    top = float(np.sqrt((rows.astype(float) ** 2).sum(axis=1).max())) * (1 + 1e-12)
    tree = cover_tree.CoverTree(rows, top)

    def below(node):
        if not tree.last[node]:
            return tree.order[tree.begin[node] : tree.end[node]].tolist()
        return [r for c in range(tree.first[node], tree.last[node]) for r in below(c)]

    for node in range(len(tree.radii)):
        points = cover_tree.augmented(rows[below(node)], top)
        centre = cover_tree.augmented(tree.centres[node : node + 1], top)[0]
        assert cover_tree.angles(points @ centre, top * top).max() <= tree.radii[node] + 1e-6
        if tree.last[node]:
            children = range(tree.first[node], tree.last[node])
            assert len(children) <= cover_tree.CHILDREN
            if len(children) < cover_tree.CHILDREN:
                assert max(tree.radii[c] for c in children) <= tree.radii[node] / 2 + 1e-6


def odd_table():
    rng = random.Random(9)
    raw = [(i, [rng.uniform(-1, 1) for _ in range(4)], rng.randint(0, 2)) for i in range(300)]
    raw += [(1000 + i, [0.5, 0.25, 0.5, -0.5], i % 2) for i in range(60)]  # copies, ties
    raw += [(400, None, 1), (401, [1.0, None, 0.0, 0.0], 1), (402, [float("nan")] * 4, 1), (403, [0.1] * 4, None)]
    raw += [(500, [0.0] * 4, 1), (600, [float("inf")] * 4, 1), (700, [0.5, 0.5], 2), (None, [0.5] * 4, 1)]
    return raw


SCHEMA = "vec_id long, embedding array<float>, label int, vec int, id string, score int"


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, monkeypatch, tmp_path, small):
    """Nulls, copies, ties, short and zero vectors, clashing columns; `small`: many blocks and
    batches, and a sample that bounds little."""
    if small:
        for name, value in (("SAMPLE", 7), ("CENTRES", 3), ("BLOCK_BYTES", 1500), ("ANCHORS", 2)):
            monkeypatch.setattr(hard_negatives, name, value)
    raw = [(i, v and [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in odd_table()]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in raw], SCHEMA)
    df.unionByName(df.limit(50)).write.parquet(f"{tmp_path}/embeddings.parquet")  # repeated rows
    rows = contract_rows(raw)
    want = by_hand(rows, {r[0] for r in rows if r[0] % 100 == 0})
    got = answers(queries.QUERIES["op11_hard_negatives"](spark, str(tmp_path)))
    assert got == want


def test_shared_ids_and_empty_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    schema = "vec_id long, label int, vec array<long>"
    rows = [(0, 1, [2, 0]), (0, 0, [1, 1]), (1, 0, [4, 4]), (2, 1, [2, 2]), (2, 1, [1, 2])]
    got = hard_negatives.mine(spark.createDataFrame(rows, schema), F.col("vec_id") == 0)
    # Of id 0 the row with label 0 counts, of id 2 the one with the lesser vector.
    assert answers(got) == {(0, 1, 1, 2, 8, 3)}
    assert hard_negatives.mine(spark.createDataFrame([], schema), F.col("vec_id") == 0).count() == 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.QUERIES["op11_hard_negatives"](spark, str(tmp_path)).count() == 0
