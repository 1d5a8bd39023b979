"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, drop, remove, shared_folder, written  # noqa: F401  operators take them from here

#: Code points of the white space that the contracts name: [\x20\x09-\x0D].
SPACES = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def md5_bucket(c: Column, n: int | Column) -> Column:
    """A stable bucket of a key that other engines can compute as well."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long") % F.lit(n)


def bucket_count(rows: int, per_bucket: int = 20_000, least: int = 512, most: int = 1 << 18) -> int:
    """Buckets that keep each near ``per_bucket`` rows; a function of the row count alone."""
    return max(least, min(most, -(-rows // per_bucket)))


def ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[str], out: str) -> DataFrame:
    """Gapless 0-based rank within ``keys`` by (bucket, order) with no task that sees a whole key.

    Rows are ranked within (keys, bucket); the few bucket totals are summed into offsets. A key
    with a third of all rows is spread over all of its buckets. Keys must not be null.
    """
    b, off = "__bucket", "__offset"
    dealt = df.withColumn(b, bucket)
    totals = dealt.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(off))
    within = Window.partitionBy(*keys, b).orderBy(*order)
    local = dealt.withColumn("__local", F.row_number().over(within) - 1)
    joined = local.join(offsets, [*keys, b])
    return joined.withColumn(out, F.col(off) + F.col("__local")).drop(b, off, "__local")
