"""Line, exact, near and embedding dedup against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from hourloom.llm import embedding_dedup, exact_dedup, line_dedup, near_dedup
from hourloom.llm.components import connected

DOCS = "doc_id long, text string, source string, row string, id long, norm string, h long"


def docs(spark, rows):
    """Rows (doc_id, text, source) with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "r", 1, "n", 2) for r in rows], DOCS)


def grouped(pairs):
    """Smallest member by member, for sets of linked pairs."""
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return find


# ------------------------------------------------------------- exact


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups(spark):
    rows = [
        (1, "Same TEXT", "a"), (2, "same text", "b"), (3, "same text ", "a"), (4, None, "a"),
        (5, "", None), (6, "É", "a"), (7, "é", "a"), (None, "same text", "a"), (None, "alone", "a"),
        (9, "x" * 200_000, "a"), (9, "X" * 200_000, "a"), (10, "one", "a"),
    ]
    got = exact_dedup.exact_groups(docs(spark, rows)).collect()
    by = defaultdict(list)
    for i, text, _ in rows:
        by[hashlib.sha256(lower(text).encode()).hexdigest()].append(i)
    want = []
    for sha, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, sha) for i in ids]
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, want))


def test_exact_dedup_keeps_rows_whole(spark):
    rows = [(1, "a", "x"), (2, "A", "y"), (3, "b", "x"), (None, None, None)]
    got = exact_dedup.exact_dedup(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns
    assert {(r.doc_id, r.text, r.row) for r in got.collect()} == {
        (2, "A", "r"), (3, "b", "r"), (None, None, "r"),
    }


def test_full_filter_changes_nothing(spark):
    """A filter far too small lets all rows through to the exact step."""
    rows = [(i, f"text {i % 70}", "a") for i in range(200)]
    df = docs(spark, rows)
    small = exact_dedup.exact_groups(df, max_filter_bits=2)
    assert sorted(small.collect()) == sorted(exact_dedup.exact_groups(df).collect())


def test_filter_in_slices(spark):
    """Rows beyond one filter are split by hash: the same groups, unique rows still cleared."""
    assert exact_dedup.filter_shape(5000, 1 << 15) == (1 << 15, 4)
    rows = [(i, f"text {i % 4500}", "a") for i in range(5000)] + [(None, "text 7", "a")]
    df = docs(spark, rows)
    whole, sliced = exact_dedup.exact_groups(df), exact_dedup.exact_groups(df, max_filter_bits=1 << 15)
    assert sorted(map(str, sliced.collect())) == sorted(map(str, whole.collect()))
    hashes = df.select("doc_id", "text", F.xxhash64("text").alias("h"))
    marked = exact_dedup.maybe_repeated(hashes, 1 << 15).collect()
    assert len(marked) == 5001
    assert all(r.maybe for r in marked if int(r.text.split()[1]) < 500)
    assert sum(r.maybe for r in marked) < 1001 + 100
    kept = exact_dedup.exact_dedup(df, max_filter_bits=1 << 15).collect()
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in whole.collect() if r.kept)


def test_exact_empty(spark):
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


# ------------------------------------------------------------- lines


def lines_by_hand(rows, min_sites=3, min_words=5):
    sites, first = defaultdict(set), {}
    norm = lambda line: " ".join(lower(line).split())

    def least(key):
        words = len(key.split())
        if words >= min_words or (words == 1 and len(key) >= 20):
            return min_sites
        return 4 * min_sites if len(key) >= 12 else None

    for i, text, site in rows:
        for p, line in enumerate((text or "").split("\n")):
            key = norm(line)
            if least(key):
                sites[key].add(site or "")
                first[key] = min(first.get(key, (i, p)), (i, p))
    out = {}
    for i, text, _ in rows:
        if text is None:
            out[i] = None
            continue
        kept = [
            line
            for p, line in enumerate(text.split("\n"))
            if len(sites.get(norm(line), ())) < (least(norm(line)) or 0) or first.get(norm(line), (i, p)) == (i, p)
        ]
        out[i] = "\n".join(kept)
    return out


def test_lines(spark):
    common = "This line stands on every  site"
    rows = [
        (1, f"{common}\nfirst own line\nshort one", "a"),
        (2, f"own\n{common.upper()}\n\n", "b"),
        (3, f"{common}\n{common}\nlast", "c"),
        (4, "short one\nfour words are few", "d"),
        (5, "four words are few", "e"), (6, "four words are few", "f"),
        (7, "only two sites have this line", "a"), (8, "only two sites have this line", "b"),
        (9, None, "a"), (10, "", "b"), (11, f"{common}", None), (12, f"x\n{common}", ""),
        (13, "\n".join(f"line number {i} of a long document" for i in range(3000)), "a"),
    ]
    got = line_dedup.line_dedup(docs(spark, rows))
    assert {r.row.doc_id: r.row.text for r in got.collect()} == lines_by_hand(rows)
    assert {r.row.doc_id: r.n_removed for r in got.collect()}[3] == 2
    assert {r.row.h for r in got.collect()} == {2}


def test_short_lines_and_lines_without_blanks(spark):
    """Short lines must spread further; blank-free scripts are measured in characters; blank
    lines and brackets never count."""
    chinese = "版权所有未经许可不得转载本网站内容如需转载请注明出处"
    rows = [(i, f"All rights reserved.\n{chinese}\n}}\n\nRead this!\nown line {i} of this text", f"s{i}") for i in range(14)]
    rows += [(20 + i, "Sold by others\n短句在此", f"s{i}") for i in range(11)]
    got = {r.row.doc_id: r.row.text for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    assert got == lines_by_hand(rows)
    assert got[5] == "}\n\nRead this!\nown line 5 of this text" and got[25] == "Sold by others\n短句在此"


def test_many_random_lines(spark):
    rng = random.Random(5)
    pool = [f"shared line with number {i} inside" for i in range(40)]
    rows = [
        (i, "\n".join(rng.choices(pool, k=3) + [f"own line of document {i} here"]), f"s{rng.randint(0, 5)}")
        for i in range(80)
    ]
    got = line_dedup.line_dedup(docs(spark, rows), min_sites=4)
    assert {r.row.doc_id: r.row.text for r in got.collect()} == lines_by_hand(rows, 4)


def test_repeated_and_null_ids(spark):
    line = "This line stands on every site"
    rows = [(1, line, "a"), (1, line, "a"), (None, line, "b"), (2, line, "c")]
    got = sorted((r.row.doc_id or 0, r.row.text) for r in line_dedup.line_dedup(docs(spark, rows)).collect())
    # The null id comes first and keeps the line.
    assert got == [(0, line), (1, ""), (1, ""), (2, "")]


def test_lines_empty(spark):
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


# ------------------------------------------------------------- components


def test_connected(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 160)]  # a path
    pairs += [(7, i) for i in range(200, 260)] + [(5, 5)]  # a star, a loop
    pairs += [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    df = spark.createDataFrame(pairs, "u long, v long")
    find = grouped([p for p in pairs if p[0] != p[1]])
    got = {r.node: r.root for r in connected(df).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert connected(df.limit(0)).count() == 0


# ------------------------------------------------------------- near


def bag(text):
    words = lower(text).split()
    n = max(len(words) - 4, 1 if words else 0)
    return Counter(tuple(words[i : i + 5]) for i in range(n))


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def near_by_hand(rows, at_least=0.8):
    bags = [bag(t) for _, t, _ in rows]
    pairs = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if (rows[i][1] or "") == (rows[j][1] or "")
        or (bags[i] and bags[j] and similarity(bags[i], bags[j]) >= at_least)
    ]
    find = grouped(pairs)
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[find(i)].append(r[0])
    named = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return Counter((r[0], named[find(i)], len(members[find(i)])) for i, r in enumerate(rows))


def some_texts(rng, n=40):
    """Base texts, copies with some words changed (some below the threshold), short ones."""
    rows = []
    for b in range(n):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 5, 30, 120, 300]))]
        rows.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, len(words) // 20, len(words) // 5])):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9999)}"
            rows.append(" ".join(copy))
    return rows


def test_near_duplicates(spark):
    rng = random.Random(11)
    texts = some_texts(rng) + ["again and again it goes on " * 60, "again and again it goes on " * 57]
    texts += [None, "", "   ", "A b C d E", "a b c d e", "a b c d", "x" * 300_000]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s"), (None, texts[0], "s"), (None, "null id", "s")]
    got = near_dedup.near_duplicates(docs(spark, rows))
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got.collect()) == near_by_hand(rows)
    kept = near_dedup.near_dedup(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert {r.doc_id for r in got.filter("kept").collect()} == {r.doc_id for r in kept.collect()}


def test_group_of_copies_over_blocks(spark, monkeypatch):
    """A star of copies that are near the base but not near each other, in many blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 4_000)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base), "s")]
    for i in range(1, 60):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(copy), "s"))
    got = near_dedup.near_duplicates(docs(spark, rows))
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got.collect()) == near_by_hand(rows)


@pytest.mark.parametrize("header, words", [(50, 42), (66, 42)])
def test_a_shared_header_makes_no_group(spark, header, words):
    """Texts that overlap by 0.3 to 0.45 share bands with many others, but nothing is compared
    beyond signatures: no candidate group is larger than the classes."""
    rng = random.Random(7)
    common = [f"h{i}" for i in range(header)]
    texts = [" ".join(common + [f"x{rng.randrange(10**6)}" for _ in range(words)]) for _ in range(300)]
    texts += [texts[0] + " y", texts[5] + " z"]
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    nodes = df.selectExpr("xxhash64(text) AS node", "text")
    signed = nodes.mapInArrow(near_dedup._sign, "node long, bands array<long>, sketch binary")
    shared = signed.selectExpr("explode(bands) AS b").groupBy("b").count()
    assert shared.agg({"count": "max"}).first()[0] > 20
    groups = Counter(r.root for r in near_dedup._candidates(signed, 0.8).collect())
    assert sorted(groups.values()) == [2, 2]
    got = near_dedup.near_duplicates(df)
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got.collect()) == near_by_hand(rows)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_ROWS", 16)
    rng = random.Random(14)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: 60 - i % 3], f"x{rng.randrange(10**9)}"]), "s") for i in range(90)]
    rows += [(100 + i, " ".join([*base[:38], *[f"z{i}-{k}" for k in range(22)]]), "s") for i in range(40)]
    got = near_dedup.near_duplicates(docs(spark, rows))
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got.collect()) == near_by_hand(rows)


def test_many_short_copies_stay_small():
    """A hot group of short near copies: memory grows with the rows of a block, not with its
    pairs, and all become one."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    n = 1500
    texts = [" ".join([*base, f"x{rng.randrange(10**9)}"]) for i in range(n)]
    batch = pa.RecordBatch.from_pydict(
        {"root": [1] * n, "a": [0] * n, "b": [0] * n, "side": [0] * n, "node": list(range(n)), "text": texts}
    )
    tracemalloc.start()
    out = list(near_dedup._verified(0.8)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(b) for b in out) == n - 1
    assert peak < 60_000_000


def test_blocks_are_bounded_by_rows(spark, monkeypatch):
    """Short texts fill a block by their number: no task holds a group of any size."""
    seen = spark.sparkContext.accumulator(0)
    verified = near_dedup._verified

    def watched(similarity):
        run = verified(similarity)

        def count(batches):
            batches = list(batches)
            sides = Counter(
                key
                for b in batches
                for key in zip(*(b.column(k).to_pylist() for k in ("root", "a", "b", "side")))
            )
            seen.add(sum(n > 60 for n in sides.values()))
            yield from run(iter(batches))

        return count

    monkeypatch.setattr(near_dedup, "_verified", watched)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 20, raising=False)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"x{i}"]), "s") for i in range(200)]
    got = near_dedup.near_duplicates(docs(spark, rows))
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got.collect()) == near_by_hand(rows)
    assert seen.value == 0


def test_signatures_are_unbiased():
    """The share of equal slots is the weighted Jaccard similarity."""
    rng = np.random.default_rng(1)
    for _ in range(6):
        n = 120
        a, b = rng.integers(0, 40, n), rng.integers(0, 40, n)
        b = np.where(rng.random(n) < 0.5, a, b)
        text = np.concatenate([np.zeros(n, int), np.ones(n, int)])
        element = np.tile(near_dedup.mix64(np.arange(n, dtype=np.uint64) + np.uint64(9)), 2)
        weight = np.concatenate([a, b])
        on = weight > 0
        sig = near_dedup.signatures(text[on], element[on], weight[on], 2, slots=4096)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 4 * 0.5 / 64


def test_near_empty(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


# ------------------------------------------------------------- embeddings


def vectors_by_hand(rows, at_least=0.95):
    good = [
        i
        for i, (_, v) in enumerate(rows)
        if v and None not in v and np.isfinite(v).all() and np.any(v)
    ]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(rows[i][1]) for i in good}
    pairs = [
        (i, j) for i in good for j in good
        if j < i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= at_least
    ]
    links = Counter(x for p in pairs for x in p)
    find = grouped(pairs)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    named = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return Counter((rows[i][0], links[i], named[find(i)]) for i in range(len(rows)))


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(24).tolist()) for i in range(150)]
    for g, size in enumerate((60, 12, 3)):  # dense groups, larger than window and block
        centre = rng.standard_normal(24)
        rows += [(1000 * (g + 1) + i, (centre + 0.08 * rng.standard_normal(24)).tolist()) for i in range(size)]
    rows += [(i + 5000, list(rows[200][1])) for i in range(20)]  # one common vector
    rows += [(6000, None), (6001, []), (6002, [0.0] * 24), (6003, [None] * 24), (6004, [float("nan")] * 24)]
    rows += [(6005, [float("inf")] * 24), (6006, [1.0]), (6007, [2.0]), (6008, [-0.0, 1.0]), (6009, [0.0, 3.0])]
    rows += [(None, list(rows[200][1])), (7, list(rows[7][1])), (None, None)]
    schema = "vec_id long, embedding array<double>, node long, root long, weight long"
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], schema)
    got = embedding_dedup.near_vectors(df, window=8, recall=0.9999)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == vectors_by_hand(rows)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_pass_count_grows_with_the_crowd():
    """Enough passes that a pair at the threshold is missed with chance 1 - recall at most."""
    before = 0
    for bits in (0, 3, 10, 20, 40):
        passes = embedding_dedup.pass_count(bits, 0.95, 0.99)
        meet = (1 - math.acos(0.95) / math.pi) ** bits
        assert passes > before and (1 - meet) ** passes <= 0.01 + 1e-12
        before = passes
    assert embedding_dedup.bits_needed({2: 500, 9: 499, 30: 1}) == 9
    assert embedding_dedup.bits_needed({2: 500, 9: 490, 30: 10}) == 30
    assert embedding_dedup.bits_needed({}) == 0


def test_one_pass_compares_windows_in_hash_order(spark):
    """The links of one pass are those of the pairs at most a window apart in the order of the
    hashes, over the ends of stretches and ranges too."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, 6, v.tolist()) for i, v in enumerate(x)], "node long, dim int, vec array<double>")
    window = 9
    seen = embedding_dedup._passes(df, 2, 3, 0.5, window, 7).collect()
    planes = np.random.default_rng([7, 6, 2]).standard_normal((6, embedding_dedup.BITS))
    keys = [(bytes(k), i) for i, k in enumerate(np.packbits(x @ planes > 0, axis=1))]
    order = [i for _, i in sorted(keys)]
    near = [
        (order[a], order[b]) for a in range(700) for b in range(a + 1, min(a + window + 1, 700))
        if x[order[a]] @ x[order[b]] >= 0.5
    ]
    links = [(r.u, r.v) for r in seen if r.kind == 0]
    assert {tuple(sorted(p)) for p in links} <= {tuple(sorted(p)) for p in near}
    ours, theirs = grouped(links), grouped(near)
    assert len({(ours(i), theirs(i)) for i in range(700)}) == len({theirs(i) for i in range(700)})
    assert sum(r.v for r in seen if r.kind == 1) <= 700


def test_vectors_in_one_cone(spark):
    """Pairs at the threshold meet though all vectors share a direction, a third a second one:
    as many passes as even directions need would lose many of them."""
    rng = np.random.default_rng(8)
    n, dim = 6000, 32

    def unit(v):
        return v / np.linalg.norm(v, axis=-1, keepdims=True)

    common = unit(rng.standard_normal(dim))
    x = unit(unit(rng.standard_normal((n, dim))) * 0.5 + common * 0.75**0.5)  # mutual cosine 0.75
    x[: n // 3] = unit(x[: n // 3] + 0.5 * unit(rng.standard_normal(dim)))
    noise = rng.standard_normal((n, dim))
    noise = unit(noise - (noise * x).sum(1, keepdims=True) * x)
    y = x[::10] * 0.951 + noise[::10] * (1 - 0.951**2) ** 0.5
    vectors = np.concatenate([x, y])
    near = vectors @ vectors.T >= 0.95
    want = [(i, j) for i, j in np.argwhere(near).tolist() if i < j]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in embedding_dedup.near_vectors(df, window=64).collect()}
    assert len(want) >= 600
    assert sum(got[i] != got[j] for i, j in want) <= 0.01 * len(want)


def test_row_names_clash(spark):
    df = spark.createDataFrame([Row(doc_id=1, text="a b c d e f", source="s", lines="l", gone=1, ends=2)])
    got = line_dedup.line_dedup(df).select("row.*").collect()[0]
    assert (got.lines, got.gone, got.ends) == ("l", 1, 2)
