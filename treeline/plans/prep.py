"""Preparation of raw social and citation datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import canonical, dense_ids, feature_hash, multi_hot, number_rows
from ..sources.text import lines, parse_citations, parse_features, parse_topics, read_int_pairs
from .lineage import cut


def social(spark: SparkSession, edges_csv: str, groups_csv: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, attributes, labels): ids are dense, attributes mark a node's groups, its label is its smallest group's place.

    Labels come from the groups that are attributes too, so they are easy to predict from them.
    """
    raw = canonical(read_int_pairs(spark, edges_csv).select(F.col("a").alias("u"), F.col("b").alias("v")))
    ids = cut(dense_ids(raw.select(F.explode(F.array("u", "v")).alias("id")), "id"))
    edges = _mapped(raw, ids)
    member = read_int_pairs(spark, groups_csv).select(F.col("a").alias("old"), F.col("b").alias("grp")).distinct().join(ids, "old").select(F.col("new").alias("id"), "grp")
    labels = least_group_label(member)
    return edges, multi_hot(member, "id", "grp").select("id", F.transform("hot", lambda x: x.cast("float")).alias("x")), labels


def least_group_label(member: DataFrame) -> DataFrame:
    """(id, y): the place of each id's smallest group among all groups of (id, grp)."""
    groups = cut(dense_ids(member, "grp"))
    return member.join(groups, member["grp"] == groups["old"]).groupBy("id").agg(F.min("new").cast("int").alias("y"))


def citation(spark: SparkSession, citations: str, topics: str, features: str, width: int = 256) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, attributes, labels): topics are numbered by first appearance among papers with citations; features are hashed."""
    raw = canonical(parse_citations(lines(spark, citations)).select(F.col("a").alias("u"), F.col("b").alias("v")))
    ids = cut(dense_ids(raw.select(F.explode(F.array("u", "v")).alias("id")), "id"))
    kept = parse_topics(lines(spark, topics)).join(ids, F.col("pid") == ids["old"]).select(F.col("new").alias("id"), "topic", "pos")
    names = number_rows(kept.groupBy("topic").agg(F.min("pos").alias("first")), ["first"], "y")
    labels = kept.groupBy("id").agg(F.max_by("topic", "pos").alias("topic")).join(names, "topic").select("id", F.col("y").cast("int").alias("y"))
    feats = parse_features(lines(spark, features)).join(ids, F.col("pid") == ids["old"]).select(F.col("new").alias("id"), F.explode("feats").alias("f"))
    hashed = feature_hash(feats.select("id", "f.k", "f.v"), "id", "k", "v", width)
    return _mapped(raw, ids), hashed.select("id", F.transform("hashed", lambda x: x.cast("float")).alias("x")), labels


def _mapped(edges: DataFrame, ids: DataFrame) -> DataFrame:
    a, b = ids.select(F.col("old").alias("u"), F.col("new").alias("nu")), ids.select(F.col("old").alias("v"), F.col("new").alias("nv"))
    return edges.join(a, "u").join(b, "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"))
