"""The folder that all executors share, and cutting lineage between rounds of an iteration."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is set, a temporary one serves a session that is one process; a cluster must name its own."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if top is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="treeline-checkpoint-"))
        top = sc.getCheckpointDir()
    return top


def _estimate_free(df: DataFrame) -> DataFrame:
    """``df`` without the size estimate that a checkpoint keeps of the plan it cuts: joins multiply it, so in loops it grows to thousands of digits."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _with(spark: SparkSession, **settings: str) -> Iterator[None]:
    names = {"cleanup": _CLEANUP, "adaptive": "spark.sql.adaptive.enabled"}
    before = {names[k]: spark.conf.get(names[k], "false") for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(names[k], v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; the shuffle files that made it go at once."""
    shared_folder(df.sparkSession)
    with _with(df.sparkSession, cleanup="true"):
        return _estimate_free(df.select("*").checkpoint(eager=True))


def cut_by(df: DataFrame, *keys: str, ordered: bool = False) -> DataFrame:
    """A checkpoint dealt by ``keys``, and in their order if ``ordered``: joins and groupings on them shuffle (and sort) these rows no more. An adaptive plan would forget how they are dealt, so this one is not."""
    shared_folder(df.sparkSession)
    with _with(df.sparkSession, cleanup="true", adaptive="false"):
        dealt = df.repartition(*keys)
        return (dealt.sortWithinPartitions(*keys) if ordered else dealt).checkpoint(eager=True)


def written(df: DataFrame, codec: str = "snappy", file_rows: int = 0) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read again, in files of at most ``file_rows`` rows if given; the shuffle files that made it go at once. ``drop`` deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with _with(spark, cleanup="true"):
        df.write.option("maxRecordsPerFile", file_rows).parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing reads them any more."""
    for t in tables:
        remove(t.sparkSession, t.written_to)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
