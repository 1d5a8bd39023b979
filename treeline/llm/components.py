"""Connected components by alternating stars, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop, written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.

    Each round links every node's larger neighbours to its smallest neighbour, then its smaller
    ones; the graph becomes a set of stars in a number of rounds that grows with the logarithm of
    its size. Minima are pre-aggregated, joins on hot centres are left to adaptive execution. Nodes
    without a link to another are left out, as are links with a null; repeated links count once. The
    result is a written table, which the caller may ``drop``.
    """
    edges, before = _seen(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        new, state = _seen(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        drop(edges, large)
        edges = new
        if state == before:
            break
        before = state
    found = written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    drop(edges)
    return found


def _seen(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges as a table, and their number and a sum of their hashes, which tell whether a round changed any."""
    state = Observation()
    out = written(edges.observe(state, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
    return out, state.get
