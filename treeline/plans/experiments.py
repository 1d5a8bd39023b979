"""Experiment runner and parameter sweep: each cell is timed around one action."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import weighted_score
from ..operators.embed import attributed_vectors, hierarchy_vectors
from ..operators.hierarchy import build_hierarchy
from ..operators.links import split_links
from ..operators.metrics import eval_link
from ..operators.node_eval import eval_node
from ..operators.walks import embed_walks
from ..sources.text import RESULT
from .lineage import cut

METHODS = ("struct", "attr", "deepwalk", "node2vec")
SWEEP = "dataset string, lambda double, beta double, partition_time_sec double, embed_time_sec double, node_accuracy_mean double, node_accuracy_std double, link_auc double, link_ap double"


def _timed(make) -> tuple[DataFrame, float]:
    began = time.perf_counter()
    return cut(make()), time.perf_counter() - began


def run_methods(edges: DataFrame, attrs: DataFrame | None, labels: DataFrame, dataset: str = "graph", methods=METHODS, dim: int = 32, damping: float = 0.01, beta: float = 0.3, lam: float = 0.2, num_walks: int = 4, walk_length: int = 20, window: int = 5, epochs: int = 1, negatives: int = 5, eval_epochs: int = 30, runs: int = 3, link_ratio: float | None = 0.1, metric: str = "dot", seed: int = 42) -> DataFrame:
    """A row of results a method. With link prediction all vectors come from the reduced training graph."""
    spark = edges.sparkSession
    train, pos, neg = (cut(x) for x in split_links(edges, link_ratio, 1.0, seed)) if link_ratio else (edges, None, None)
    made = {
        "struct": lambda: hierarchy_vectors(build_hierarchy(train, "1", seed=seed), dim, damping, seed),
        "attr": lambda: attributed_vectors(build_hierarchy(train, "4", attrs, lam, seed), attrs, dim, damping, beta, seed),
        "deepwalk": lambda: embed_walks(train, "deepwalk", dim, walk_length, num_walks, window, epochs, negatives, seed=seed),
        "node2vec": lambda: embed_walks(train, "node2vec", dim, walk_length, num_walks, window, epochs, negatives, p=1.0, q=0.5, seed=seed),
    }
    rows = []
    for m in methods:
        if m == "attr" and attrs is None:
            continue
        began = time.perf_counter()
        vectors, embed = _timed(made[m])
        node = eval_node(vectors, labels, runs=runs, epochs=eval_epochs, seed=seed).first()
        link = eval_link(vectors, pos, neg, metric).first() if link_ratio else None
        rows.append((dataset, m, time.perf_counter() - began, embed, node["accuracy_mean"], node["accuracy_std"], link and link["link_auc"], link and link["link_ap"], None))
    return spark.createDataFrame(rows, RESULT)


def sweep(edges: DataFrame, attrs: DataFrame, labels: DataFrame, lambdas: list[float], betas: list[float], dataset: str = "graph", dim: int = 32, damping: float = 0.01, eval_epochs: int = 5, runs: int = 1, link_ratio: float | None = 0.1, seed: int = 42) -> DataFrame:
    """A row a (lambda, beta), best weighted score first; the hierarchy of a lambda is built once for all betas."""
    spark = edges.sparkSession
    train, pos, neg = (cut(x) for x in split_links(edges, link_ratio, 1.0, seed)) if link_ratio else (edges, None, None)
    rows = []
    for lam in lambdas:
        nodes, part = _timed(lambda: build_hierarchy(train, "4", attrs, lam, seed))
        for beta in betas:
            vectors, embed = _timed(lambda: attributed_vectors(nodes, attrs, dim, damping, beta, seed))
            node = eval_node(vectors, labels, runs=runs, epochs=eval_epochs, seed=seed).first()
            link = eval_link(vectors, pos, neg).first() if link_ratio else None
            rows.append((dataset, lam, beta, part, embed, node["accuracy_mean"], node["accuracy_std"], link and link["link_auc"], link and link["link_ap"]))
    return ranked_sweep(spark.createDataFrame(rows, SWEEP))


def ranked_sweep(cells: DataFrame, selection: str = "weighted_score") -> DataFrame:
    """Cells with ``weighted_score``, best first; a missing value counts -1, ties keep (lambda, beta) order."""
    scored = cells.withColumn("weighted_score", weighted_score(F.col("node_accuracy_mean"), F.col("link_auc")))
    return scored.orderBy(F.coalesce(F.col(selection), F.lit(-1.0)).desc(), "lambda", "beta")


def parse_grid(text: str) -> list[float]:
    return [float(x) for x in text.split(",") if x.strip()]


def method_pivot(results: DataFrame, metric: str, methods: list[str]) -> DataFrame:
    """dataset x method table of a metric; missing cells are 0."""
    return results.groupBy("dataset").pivot("method", methods).agg(F.first(metric, ignorenulls=True)).na.fill(0.0, methods)
