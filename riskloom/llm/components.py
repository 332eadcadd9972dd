"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import landed


def _state(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; the root is the least node reachable.

    Each round keeps at most as many rows as there are links. Only minima are grouped (combined
    before the shuffle) and the rest are joins, which adaptive execution splits at hot nodes. The
    state of every round is written to the shared folder. Null ends and self links are dropped;
    an empty table gives an empty result.
    """
    a, b = F.col("a"), F.col("b")
    edges = landed(
        links.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    state = _state(edges)
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        # Large star: everything above u moves to the least of u and its neighbours.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        large = landed(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("w"))
        # Small star: u and its smaller neighbours move to the least of them.
        small = large.join(low, "u").where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"))
        edges = landed(small.union(low.select("u", F.col("w").alias("v"))).distinct(), "small-star")
        before, state = state, _state(edges)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
