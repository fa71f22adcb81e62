"""Connected components by alternating large-star and small-star steps, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, freed_shuffles


def _state(edges: DataFrame) -> tuple:
    with freed_shuffles(edges.sparkSession):
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "p").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of an undirected edge list; root is the smallest node that can be reached.

    Nodes are non-null longs; self-loops and repeated edges are allowed and a self-loop alone gives no row.
    A hub's minimum is aggregated before the shuffle, by one column more than the join has, so that the join deals both
    sides anew and AQE can split the hub's edges. Each round is cut by a reliable checkpoint.
    """
    e = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("p")).where("v <> p").distinct()
    e = checkpointed(e)
    state = _state(e)
    for _ in range(max_rounds):
        # large-star: what is larger than a node and next to it moves to the least of its neighbourhood
        both = e.select(F.col("v").alias("u"), F.col("p").alias("w")).unionAll(e.select(F.col("p").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u", F.xxhash64("u")).agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("m").alias("p")).where("v <> p").distinct()
        large = checkpointed(large)
        # small-star: a node's smaller neighbours, and the node, move to the least of them
        low = large.groupBy("v", F.xxhash64("v")).agg(F.min("p").alias("m")).select("v", "m")
        moved = large.join(low, "v").where("p <> m").select(F.col("p").alias("v"), F.col("m").alias("p"))
        e = checkpointed(moved.unionAll(low.select("v", F.col("m").alias("p"))).distinct())
        now = _state(e)
        if now == state:
            return e.select(F.col("v").alias("node"), F.col("p").alias("root"))
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
