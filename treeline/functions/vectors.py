"""Scalar and array functions on vectors and scores, all of them JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The guard added to norms and to the softmax denominator, and the sigmoid's clipping.
EPS = 1e-12
SIGMOID_AT, SIGMOID_HIGH, SIGMOID_LOW = 8.0, 0.9997, 0.0003


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vsum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column | str) -> Column:
    """Elements widened one by one, so float inputs are not multiplied in single precision."""
    return F.transform(_col(v), lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return vsum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(EPS)) * (norm(b) + F.lit(EPS)))


def edge_score(a: Column | str, b: Column | str, metric: str = "dot") -> Column:
    """Score of a pair; null if a vector is missing."""
    if metric not in ("dot", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    made = dot(a, b) if metric == "dot" else cosine(a, b)
    return F.when(_col(a).isNotNull() & _col(b).isNotNull(), made)


def l2_normalize(v: Column | str) -> Column:
    n = norm(v) + F.lit(EPS)
    return F.transform(_col(v), lambda x: x.cast("double") / n)


def add_scaled(a: Column | str, b: Column | str, s: Column | float) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y * s)


def sigmoid(x: Column | str) -> Column:
    x = _col(x)
    return F.when(x > SIGMOID_AT, SIGMOID_HIGH).when(x < -SIGMOID_AT, SIGMOID_LOW).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def softmax(v: Column | str) -> Column:
    v = _col(v)
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / (vsum(e) + F.lit(EPS)))


def argmax(v: Column | str) -> Column:
    """0-based place of the greatest element, the first of equals."""
    v = _col(v)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def structural_gain(weight: Column, tot: Column, degree: Column, m2: Column) -> Column:
    """Gain of joining a community, times m2, so integer weights compare exactly."""
    return weight * m2 - tot * degree


def attribute_gain(x: Column, total: Column, size: Column, lam: float) -> Column:
    """lam times the cosine of a node's attributes with its community's mean (the mean's size cancels); 0 where undefined."""
    if lam <= 0:
        return F.lit(0.0)
    n = norm(x) * norm(total)
    return F.when(x.isNotNull() & (size > 0) & (n > 0), F.lit(float(lam)) * dot(x, total) / n).otherwise(F.lit(0.0))


def mat_vec(rows: list[list[float]], v: Column | str) -> Column:
    """Product of a small constant matrix, given by rows, and a vector."""
    return F.array(*[dot(F.array(*[F.lit(float(x)) for x in r]), v) for r in rows])


def duration_text(seconds: Column | str) -> Column:
    """Whole hours, minutes and seconds, as in ``0h1m5s``."""
    s = F.floor(_col(seconds)).cast("long")
    part = lambda x: x.cast("long").cast("string")
    return F.concat(part(F.floor(s / 3600)), F.lit("h"), part(F.floor(s / 60) % 60), F.lit("m"), part(s % 60), F.lit("s"))


def weighted_score(acc: Column, auc: Column, acc_weight: float = 0.7, auc_weight: float = 0.3) -> Column:
    """Weighted sum of accuracy and AUC; accuracy alone without link prediction."""
    return F.when(auc.isNull(), acc).otherwise(F.lit(acc_weight) * acc + F.lit(auc_weight) * auc)
