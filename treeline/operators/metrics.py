"""Evaluation metrics as plans: AUC, average precision, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import edge_score
from .graph import number_rows


def _score_totals(scores: DataFrame) -> DataFrame:
    return scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))


def auc(scores: DataFrame) -> DataFrame:
    """One row (auc) of (score, label 0/1) with mean ranks for ties; 0.0 if a class is empty.

    Rows are first reduced to one a distinct score; ranks come from range partitions, not from a global window.
    """
    from ..plans.lineage import cut

    totals = cut(_score_totals(scores).repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    parts = totals.groupBy("part").agg(F.sum("n").alias("pn"))
    shift = parts.select("part", F.coalesce(F.sum("pn").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    local = totals.withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy("score")))
    # One row a partition: bounded by the number of shuffle partitions.
    ranked = local.join(F.broadcast(shift), "part").withColumn("rank", F.col("shift") + F.col("upto") - (F.col("n") - 1) / F.lit(2.0))
    s = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").cast("double").alias("p"), F.sum(F.col("n") - F.col("p")).cast("double").alias("q"))
    return s.select(F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / F.lit(2.0)) / (F.col("p") * F.col("q"))).otherwise(0.0).alias("auc"))


def average_precision(scores: DataFrame) -> DataFrame:
    """One row (ap) by descending score; positives come first among ties; 0.0 without positives."""
    rows = scores.select((-F.col("score")).alias("k"), (-F.col("label")).alias("t"), F.xxhash64(*scores.columns).alias("h"))
    placed = number_rows(rows, ["k", "t", "h"], "place", start=1)
    hits = number_rows(placed.where("t = -1").select("place"), ["place"], "hit", start=1)
    return hits.agg(F.coalesce(F.avg(F.col("hit") / F.col("place")), F.lit(0.0)).alias("ap"))


def pair_scores(pairs: DataFrame, vectors: DataFrame, metric: str = "dot") -> DataFrame:
    """(u, v, label, score) of pairs with both vectors."""
    a, b = vectors.select(F.col("id").alias("u"), F.col("v").alias("a")), vectors.select(F.col("id").alias("v"), F.col("v").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "label", edge_score("a", "b", metric).alias("score"))


def eval_link(vectors: DataFrame, positive: DataFrame, negative: DataFrame, metric: str = "dot") -> DataFrame:
    """One row: link_auc, link_ap, n_test_pos_used, n_test_neg_used."""
    from ..plans.lineage import cut

    pairs = positive.select("u", "v", F.lit(1).alias("label")).unionByName(negative.select("u", "v", F.lit(0).alias("label")))
    scores = cut(pair_scores(pairs, vectors, metric))
    used = scores.agg(F.count_if(F.col("label") == 1).alias("n_test_pos_used"), F.count_if(F.col("label") == 0).alias("n_test_neg_used"))
    one = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731  one row each
    return one(auc(scores).withColumnRenamed("auc", "link_auc")).join(one(average_precision(scores).withColumnRenamed("ap", "link_ap")), "one").join(one(used), "one").drop("one")


def accuracy(predicted: DataFrame) -> DataFrame:
    """One row (accuracy) of (y, predicted); 0 for no rows."""
    return predicted.agg(F.coalesce(F.avg((F.col("y") == F.col("predicted")).cast("double")), F.lit(0.0)).alias("accuracy"))


def mean_std(df: DataFrame, col: str, *by) -> DataFrame:
    """(mean, std of the population), a row a group of ``by`` if given."""
    return df.groupBy(*by).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))
