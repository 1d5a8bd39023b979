"""Optional extension: a stream of edges as running degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degree_stream(edges: DataFrame) -> DataFrame:
    """(id, degree) of a streaming (u, v): the same plan as the batch operator, kept up to date by the state store (output mode complete or update)."""
    return edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
