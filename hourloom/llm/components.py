"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import spread_join, stored


def _fingerprint(edges: DataFrame) -> tuple:
    """Tells whether a round changed anything; one row is collected."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    got = edges.agg(F.count("*").alias("n"), F.sum(h).alias("h")).first()
    return got.n, got.h


def connected(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of `edges` (u, v): root is the smallest node reachable.

    Each round links every larger neighbour of a node to the smallest one, then every smaller
    neighbour too, until nothing changes; paths shrink geometrically. A hot node's minimum is
    an aggregate with partial results and its links are split by the skew join. Each round is
    written to the shared folder, which also cuts the lineage. Loops and repeated links do no
    harm; no edges give no rows.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = stored(pairs.filter("u <> v").distinct(), label)
    seen = _fingerprint(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, least, ["u"]).filter("v > u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = spread_join(large, least, ["u"]).filter("v <> m")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(
            small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label
        )
        before, seen = seen, _fingerprint(now)
        if before == seen:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
