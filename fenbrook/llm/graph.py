"""Connected components of an edge table, by alternating stars, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, spread_join, stage


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); component is the smallest node reachable.

    Each round points the larger neighbours of each node, then its smaller ones, to the smallest
    neighbour; the number of rounds grows with the logarithm of the longest path. Self-loops and
    repeated edges change nothing; no edges give no rows. Each round is a staged table; a node with very many
    neighbours is split. Raises if ``max_rounds`` do not settle it.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state, done = _state(now), False
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w")).select("u", F.least("u", "m").alias("m"), "w"))
        large = stage(spread_join(both, least, "u", "w").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        first = stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w")))
        rest = spread_join(large, first, "u", "w").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, stage(rest.union(first.select("u", "m")).distinct())
        release(before, least, large, first)
        if done := state == (state := _state(now)):
            break
    if not done:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops.select("node", F.col("node").alias("component")))


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
