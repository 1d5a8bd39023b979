"""Comparison of a Spark result with DuckDB's, whatever the order of rows."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_cell, v)) + "]"
    return f"{v:.9g}" if isinstance(v, float) else str(int(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted("|".join(map(_cell, r)) for r in df[cols].astype(object).itertuples(index=False, name=None))


def floats_alike(a, b):
    """Integers that pandas holds as floats because of nulls compare as such."""
    out = []
    for df in (a, b):
        out.append(df.apply(lambda s: s.astype(object).map(lambda v: int(v) if isinstance(v, float) and v.is_integer() else v)))
    return out


def assert_same(spark_df, sql, con):
    a, b = floats_alike(spark_df.toPandas(), con.execute(sql).fetchdf())
    assert rows(a) == rows(b)
