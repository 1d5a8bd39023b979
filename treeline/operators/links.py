"""Link prediction splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import hash52
from ..plans.lineage import cut
from .graph import canonical, degree, number_rows, rank_within


def greedy_test_edges(edges: DataFrame, ratio: float, seed: int, max_rounds: int = 1_000) -> DataFrame:
    """Test edges of the greedy rule: in hash order an edge goes to the test set if it leaves both ends a degree of one at least.

    Solved as a b-matching in rounds: an edge that is among the first ``spare`` of both ends, is accepted by the
    sequential rule too; accepted edges use their ends' spare degree up, edges at saturated ends drop out. Ranks at a node come
    from range partitions, so a hub is no single task; every round accepts the first open edge at least.
    """
    base = cut(canonical(edges).withColumn("k", hash52(seed, F.col("u"), F.col("v"))))
    target = int(base.count() * ratio)
    spare = cut(degree(base).select("id", (F.col("degree") - 1).alias("spare")))
    open_, taken = base, []
    for _ in range(max_rounds):
        ends = open_.select("u", "v", "k", F.explode(F.array("u", "v")).alias("id")).join(spare, "id")
        first = rank_within(ends, "id", ["k", "u", "v"], "r")
        marks = first.groupBy("u", "v", "k").agg(F.max((F.col("spare") <= 0).cast("int")).alias("full"), F.min((F.col("r") < F.col("spare")).cast("int")).alias("ok"))
        marks = cut(marks)
        got = marks.where("ok = 1 and full = 0").select("u", "v", "k")
        if got.isEmpty():
            break
        taken.append(got)
        used = got.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").count()
        spare = cut(spare.join(used, "id", "left").select("id", (F.col("spare") - F.coalesce("count", F.lit(0))).alias("spare")))
        open_ = marks.where("full = 0 and ok = 0").select("u", "v", "k")
    if not taken:
        return base.where("false").select("u", "v")
    found = taken[0]
    for t in taken[1:]:
        found = found.unionByName(t)
    return number_rows(found, ["k", "u", "v"], "place").where(F.col("place") < target).select("u", "v")


def sample_negatives(nodes: DataFrame, edges: DataFrame, n: int, seed: int, tries: int = 20) -> DataFrame:
    """n distinct pairs u < v of nodes (id, dense from 0) that are no edges; an error if there are too few."""
    count = nodes.count()
    known = cut(canonical(edges))
    possible = count * (count - 1) // 2 - known.count()
    if n > possible:
        raise ValueError(f"{n} negatives asked for; the graph has {possible} pairs without an edge")
    spark, draws = nodes.sparkSession, max(64, 2 * n)
    for _ in range(tries):
        drawn = spark.range(draws).select((hash52(seed, "u", F.col("id")) % count).alias("a"), (hash52(seed, "v", F.col("id")) % count).alias("b"), "id")
        pairs = drawn.where("a <> b").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("id").alias("at"))
        free = pairs.join(known, ["u", "v"], "left_anti")
        got = cut(number_rows(free, ["at", "u", "v"], "place").where(F.col("place") < n))
        if got.count() == n:
            return got.select("u", "v")
        draws *= 2
    raise RuntimeError("too few negatives after all tries")


def split_links(edges: DataFrame, ratio: float = 0.1, negatives: float = 1.0, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test positives, test negatives), edges u < v."""
    known = cut(canonical(edges))
    test = cut(greedy_test_edges(known, ratio, seed))
    train = known.join(test, ["u", "v"], "left_anti")
    from .graph import dense_ids

    ids = cut(dense_ids(known.select(F.explode(F.array("u", "v")).alias("id")), "id"))
    near = known.join(ids.select(F.col("old").alias("u"), F.col("new").alias("nu")), "u").join(ids.select(F.col("old").alias("v"), F.col("new").alias("nv")), "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"))
    drawn = sample_negatives(ids.select(F.col("new").alias("id")), near, int(test.count() * negatives), seed + 1337)
    back = drawn.join(ids.select(F.col("new").alias("u"), F.col("old").alias("ou")), "u").join(ids.select(F.col("new").alias("v"), F.col("old").alias("ov")), "v")
    return train, test, back.select(F.least("ou", "ov").alias("u"), F.greatest("ou", "ov").alias("v"))
