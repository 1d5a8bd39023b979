"""Readers and writers of the text formats, each a DataFrame plan over ``spark.read.text``.

``mode='strict'`` fails on a malformed row, ``'lenient'`` leaves it out; nothing is cut off silently.
Duplicates are resolved by file order: ``pos`` is the file's order, as a number that grows within a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Fixed value: a number in the text formats.
_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, pos). Text splits keep file order, so partition and row make an increasing position."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("pos"))


def tokens(c: Column | str = "value") -> Column:
    return F.filter(F.split(F.trim(F.col(c) if isinstance(c, str) else c), r"[ \t\r\n]+"), lambda x: x != "")


def _checked(df: DataFrame, ok: Column, mode: str, what: str) -> DataFrame:
    if mode == "lenient":
        return df.where(ok)
    if mode != "strict":
        raise ValueError(f"unknown mode {mode!r}")
    return df.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit(f"malformed {what}: "), F.col("value")))))


def read_edges(spark: SparkSession, path: str | list[str], mode: str = "strict") -> DataFrame:
    """(u, v, pos) as written: duplicates and self-loops stay."""
    rows = lines(spark, path).withColumn("t", tokens()).where(F.size("t") > 0)
    rows = _checked(rows, (F.size("t") == 2) & F.forall("t", lambda x: x.rlike("^[0-9]{1,18}$")), mode, "edge")
    return rows.select(F.col("t")[0].cast("long").alias("u"), F.col("t")[1].cast("long").alias("v"), "pos")


def _keyed(spark: SparkSession, path: str, mode: str, what: str, kind: str, out: str) -> DataFrame:
    rows = lines(spark, path).withColumn("t", tokens()).where(F.size("t") > 1)
    ok = F.col("t")[0].rlike("^[0-9]{1,18}$") & F.forall(F.slice("t", F.lit(2), F.size("t") - 1), lambda x: x.rlike(f"^{_NUMBER}$"))
    rows = _checked(rows, ok, mode, what)
    values = F.transform(F.slice("t", F.lit(2), F.size("t") - 1), lambda x: x.cast(kind))
    return rows.select(F.col("t")[0].cast("long").alias("id"), values.alias(out), "pos")


def last_wins(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, "pos").alias(value))


def check_width(df: DataFrame, col: str) -> DataFrame:
    """Fails if vectors differ in length. One small aggregate over the table."""
    widths = df.agg(F.min(F.size(col)).alias("a"), F.max(F.size(col)).alias("b")).first()
    if widths["a"] != widths["b"]:
        raise ValueError(f"inconsistent dimension: {widths['a']} to {widths['b']}")
    return df


def read_attributes(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """(id, x array<float>): lines without values are skipped, widths must agree, the last line of an id wins."""
    return last_wins(check_width(_keyed(spark, path, mode, "attributes", "float", "x"), "x"), "id", "x")


def read_vectors(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    return last_wins(_keyed(spark, path, mode, "vector", "double", "v"), "id", "v")


def read_labels(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    rows = _keyed(spark, path, mode, "label", "double", "y")
    return last_wins(rows.select("id", F.col("y")[0].cast("int").alias("y"), "pos"), "id", "y")


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """Records (pos, depth, children, members, parent) of a pre-order hierarchy file; ``parent`` is the nearest earlier record one level up.

    The native form of a hierarchy is the table of paths.
    """
    rows = lines(spark, path).withColumn("t", tokens()).where(F.size("t") > 0)
    n = F.col("t")[1].cast("int")
    records = rows.select("pos", F.col("t")[0].cast("int").alias("depth"), n.alias("children"),
                          F.when(n == 1, F.transform(F.slice("t", F.lit(4), F.greatest(F.size("t") - 3, F.lit(0))), lambda x: x.cast("long"))).alias("members"),
                          F.when(n == 1, F.get("t", F.lit(2)).cast("int")).alias("declared"))
    return with_parents(records)


def with_parents(records: DataFrame) -> DataFrame:
    """Adds ``parent``: the last earlier position with depth one less.

    Records are range-partitioned by position. Each partition keeps the open ancestors as a running map of the last position by depth;
    what was open before it comes from the last positions by depth of all partitions before, one row a partition.
    """
    dealt = cut(records.repartitionByRange("pos").withColumn("__p", F.spark_partition_id()))
    # One row a partition and depth: the depths of a tree, not its records.
    last = dealt.groupBy("__p", "depth").agg(F.max("pos").alias("__last"))
    parts = dealt.select("__p").distinct()
    earlier = parts.select(F.col("__p").alias("__q")).join(F.broadcast(last), F.col("__p") < F.col("__q")).groupBy("__q", "depth").agg(F.max("__last").alias("__carried"))
    earlier = earlier.select(F.col("__q").alias("__p"), (F.col("depth") + 1).alias("depth"), "__carried")
    # Within a partition the last record of each depth before a place: one running window by (partition, depth of a possible parent).
    up = dealt.select("__p", "pos", (F.col("depth") + 1).alias("depth"), F.col("pos").alias("__from"))
    asked = dealt.select("__p", "pos", "depth", F.lit(None).cast("long").alias("__from"))
    before = Window.partitionBy("__p", "depth").orderBy("pos", F.col("__from").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    near = up.unionByName(asked).withColumn("__near", F.max("__from").over(before)).where("__from is null").select("pos", "__near")
    found = dealt.join(near, "pos").join(F.broadcast(earlier), ["__p", "depth"], "left")
    return found.withColumn("parent", F.coalesce("__near", "__carried")).select(*records.columns, "parent")


def check_hierarchy(records: DataFrame) -> DataFrame:
    """Fails if a record has another number of children or members than it declares (a file that was cut short)."""
    found = records.where("parent is not null").groupBy(F.col("parent").alias("pos")).count()
    bad = records.join(found, "pos", "left").where(
        F.when(F.col("children") > 1, F.coalesce("count", F.lit(0)) != F.col("children")).otherwise(~F.coalesce(F.size("members") == F.col("declared"), F.lit(False)))).limit(1).count()
    if bad:
        raise ValueError("truncated or inconsistent hierarchy")
    return records


def hierarchy_lines(nodes: DataFrame) -> DataFrame:
    """Lines of the pre-order format from (id, path): an inner record lists its number of children, a leaf its members."""
    leaf = nodes.groupBy("path").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    inner = nodes.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda i: F.struct(F.slice("path", F.lit(1), i).alias("path"), F.get("path", i).alias("child")))).alias("p")).where(F.size("path") > 0).select("p.*").distinct()
    inner = inner.groupBy("path").agg(F.count(F.lit(1)).alias("c"))
    a = inner.select("path", F.concat_ws(" ", F.size("path").cast("string"), F.col("c").cast("string")).alias("value"))
    b = leaf.select("path", F.concat_ws(" ", F.size("path").cast("string"), F.lit("1"), F.size("ids").cast("string"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")).alias("value"))
    return a.unionByName(b).orderBy("path").select("value")


def write_lines(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)


def edge_lines(edges: DataFrame, ordered: bool = False) -> DataFrame:
    rows = edges.orderBy("u", "v") if ordered else edges
    return rows.select(F.concat_ws(" ", F.col("u").cast("string"), F.col("v").cast("string")).alias("value"))


def vector_lines(vectors: DataFrame, style: str = "e", col: str = "v") -> DataFrame:
    """Style ``e`` writes exponents with six digits, ``f`` eight decimals."""
    form = {"e": "%e", "f": "%.8f"}[style]
    return vectors.orderBy("id").select(F.concat_ws(" ", F.col("id").cast("string"), F.array_join(F.transform(col, lambda x: F.format_string(form, x.cast("double"))), " ")).alias("value"))


def map_lines(names: DataFrame) -> DataFrame:
    """Lines of a renumbering (new, old), in the order of the new ids."""
    return names.orderBy("new").select(F.concat_ws(" ", F.col("new").cast("string"), F.col("old").cast("string")).alias("value"))


def label_lines(labels: DataFrame) -> DataFrame:
    return labels.orderBy("id").select(F.concat_ws(" ", F.col("id").cast("string"), F.col("y").cast("string")).alias("value"))


def parse_citations(df: DataFrame) -> DataFrame:
    """(a, b, pos) of ``Cite(a,b)=`` lines; others are left out."""
    p = r"^Cite\(\s*([0-9]+)\s*,\s*([0-9]+)\s*\)="
    return df.where(F.col("value").rlike(p)).select(F.regexp_extract("value", p, 1).cast("long").alias("a"), F.regexp_extract("value", p, 2).cast("long").alias("b"), "pos")


def parse_topics(df: DataFrame) -> DataFrame:
    """(pid, topic, pos) of ``topic(pid)=`` lines."""
    p = r"^([^(]*)\(([0-9]+)\)="
    return df.where(F.col("value").rlike(p)).select(F.regexp_extract("value", p, 2).cast("long").alias("pid"), F.regexp_extract("value", p, 1).alias("topic"), "pos")


def parse_features(df: DataFrame) -> DataFrame:
    """(pid, feats array of (k, v), pos) of ``pid;...;k:v,k:v`` lines."""
    part = F.split("value", ";")
    kv = F.filter(F.split(F.get(part, F.lit(2)), ","), lambda t: t.rlike(f":{_NUMBER}$"))
    feats = F.transform(kv, lambda t: F.struct(F.substring_index(t, ":", 1).alias("k"), F.substring_index(t, ":", -1).cast("double").alias("v")))
    return df.where(F.size(part) >= 3).select(F.get(part, F.lit(0)).try_cast("long").alias("pid"), feats.alias("feats"), "pos").where("pid is not null")


def read_int_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV of two integers; rows with fewer fields are left out."""
    return spark.read.schema("a long, b long").csv(path, mode="DROPMALFORMED").where("a is not null and b is not null")


RESULT = "dataset string, method string, total_time_sec double, embed_time_sec double, node_accuracy_mean double, node_accuracy_std double, link_auc double, link_ap double, vectors string"


def read_results(spark: SparkSession, paths: list[str], schema: str = RESULT) -> DataFrame:
    """Result CSVs with headers, without the rows of the build step."""
    rows = spark.read.csv(paths, header=True, schema=schema)
    return rows.where("method <> 'compile'") if "method" in rows.columns else rows


def read_results_if_any(spark: SparkSession, path: str, schema: str = RESULT) -> DataFrame:
    try:
        return read_results(spark, [path], schema)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_results(df: DataFrame, path: str, append: bool = False) -> None:
    """Result rows as CSV parts, each with a header; they are read together by ``read_results``."""
    df.write.mode("append" if append else "overwrite").csv(path, header=True)


def result_lines(df: DataFrame) -> DataFrame:
    """Result rows as lines under one header, for a single file; result tables are small."""
    head = df.sparkSession.range(1).select(F.lit(0).alias("o"), F.lit(",".join(df.columns)).alias("value"))
    rows = df.select(F.lit(1).alias("o"), F.to_csv(F.struct(*df.columns)).alias("value"))
    return head.unionByName(rows).coalesce(1).sortWithinPartitions("o").select("value")


def planted_blocks(spark: SparkSession, n: int = 200, p_in: float = 0.08, p_out: float = 0.01, seed: int = 42):
    """Edges, attributes and labels of a two-block random graph; three Gaussian attributes, of which two tell the block.

    Pairs are drawn by comparing all i < j: the generator is meant for small n.
    """
    from ..functions.rng import uniform

    block = lambda c: (c >= n // 2).cast("int")
    i, j = spark.range(n).select(F.col("id").alias("u")), spark.range(n).select(F.col("id").alias("v"))
    p = F.when(block(F.col("u")) == block(F.col("v")), p_in).otherwise(p_out)
    edges = i.join(j, F.col("u") < F.col("v")).where(uniform(seed, F.col("u"), F.col("v")) < p)
    gauss = lambda t: F.sqrt(-2.0 * F.log(1.0 - uniform(seed, "a", F.col("id"), t))) * F.cos(6.283185307179586 * uniform(seed, "b", F.col("id"), t))
    sign = F.when(block(F.col("id")) == 0, 1.0).otherwise(-1.0)
    attrs = spark.range(n).select("id", F.array((sign + 0.3 * gauss(1)).cast("float"), (-sign + 0.3 * gauss(2)).cast("float"), gauss(3).cast("float")).alias("x"))
    return edges, attrs, spark.range(n).select("id", block(F.col("id")).alias("y"))
