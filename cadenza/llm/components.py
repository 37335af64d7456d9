"""Connected components by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.workspace import Workspace


def components(edges: DataFrame, ws: Workspace, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node of its component.

    Each round links every node's larger neighbours to its least neighbour (large star), then its smaller
    ones (small star). Both shrink the longest path, so rounds grow with the logarithm of the size. No
    neighbour list is ever gathered: a round is an aggregate ``min`` with map-side combine and a join that
    adaptive execution can split, so a hub node costs no single task. Empty input gives an empty result.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = ws.table(f"{name}-0", pairs)
    seen = None
    for k in range(1, max_rounds + 1):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = ws.table(f"{name}-large-{k}", large.distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e"))
        pairs = ws.table(f"{name}-{k}", small.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a <> b").distinct())
        mark = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen == tuple(mark):
            break
        seen = tuple(mark)
        ws.drop(f"{name}-{k - 1}", f"{name}-large-{k}")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
