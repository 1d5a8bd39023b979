"""Node classification by softmax regression, trained by full-batch gradient descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import hash52
from ..functions.vectors import EPS
from ..plans.lineage import cut
from .graph import number_rows


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    e = np.exp(z - z.max(1, keepdims=True))
    return e / (e.sum(1, keepdims=True) + EPS)


def train_softmax(rows: DataFrame, classes: int, dim: int, epochs: int = 60, lr: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(W dim x classes, b): each epoch sums the gradients of all batches by Spark; only the summed gradient reaches the driver."""
    w, b, n = np.zeros((dim, classes)), np.zeros(classes), rows.count()
    spark = rows.sparkSession
    for _ in range(epochs if n else 0):
        model = spark.sparkContext.broadcast((w, b))

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w, b = model.value
            g = np.zeros((w.shape[0] + 1, w.shape[1]))
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["v"].to_numpy()).astype(float)
                    p = _softmax(x @ w + b)
                    p[np.arange(len(x)), pdf["c"].to_numpy()] -= 1
                    g[:-1] += x.T @ p
                    g[-1] += p.sum(0)
            yield pd.DataFrame({"i": np.arange(g.size), "g": g.ravel()})

        sums = rows.select("v", "c").mapInPandas(partial, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas().sort_values("i")["g"].to_numpy()
        g = sums.reshape(dim + 1, classes) / n
        w -= lr * (g[:-1] + l2 * w)
        b -= lr * g[-1]
    return w, b


def predict(rows: DataFrame, w: np.ndarray, b: np.ndarray) -> DataFrame:
    """Adds ``predicted``: the class with the greatest score, the lowest of equals."""
    model = rows.sparkSession.sparkContext.broadcast((w, b))

    @F.pandas_udf("int")
    def best(v: pd.Series) -> pd.Series:
        w, b = model.value
        return pd.Series((np.stack(v.to_numpy()).astype(float) @ w + b).argmax(1).astype("int32")) if len(v) else pd.Series([], dtype="int32")

    return rows.withColumn("predicted", best("v"))


def rank_split(rows: DataFrame, ratio: float, seed: int, run: int) -> DataFrame:
    """Adds ``train``: the first floor(n * ratio) rows in hash order."""
    n = rows.count()
    placed = number_rows(rows.withColumn("__k", hash52(seed, run, F.col("id"))), ["__k", "id"], "__r")
    return placed.withColumn("train", F.col("__r") < int(n * ratio)).drop("__k", "__r")


def eval_node(vectors: DataFrame, labels: DataFrame, train_ratio: float = 0.5, runs: int = 5, epochs: int = 60, lr: float = 0.1, l2: float = 1e-4, seed: int = 42) -> DataFrame:
    """One row: accuracy_mean, accuracy_std (population), n_eval_nodes; nulls for no common nodes."""
    spark = vectors.sparkSession
    names = labels.select("y").distinct().orderBy("y").toPandas()["y"].tolist()  # classes
    known = cut(vectors.join(labels, "id").select("id", "v", (F.array_position(F.array(*[F.lit(y) for y in names]) if names else F.array(F.lit(0)), F.col("y")) - 1).cast("int").alias("c")))
    n, first = known.count(), known.first()
    found = []
    for run in range(runs if first else 0):
        rows = cut(rank_split(known, train_ratio, seed, run))
        w, b = train_softmax(rows.where("train"), len(names), len(first["v"]), epochs, lr, l2)
        test = predict(rows.where("not train"), w, b)
        found.append(test.agg(F.avg((F.col("predicted") == F.col("c")).cast("double"))).first()[0])
    found = [x for x in found if x is not None]
    mean = float(np.mean(found)) if found else None
    return spark.createDataFrame([(mean, float(np.std(found)) if found else None, n)], "accuracy_mean double, accuracy_std double, n_eval_nodes long")
