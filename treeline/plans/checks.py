"""Queries that write and read the text formats, and queries over results that SQL can foretell.

Files go to the shared folder and are read back from there, so a row of these queries has been through a writer and a reader.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import add_scaled, argmax, duration_text, mat_vec, sigmoid, softmax
from ..operators import graph, hierarchy, links, node_eval, partition, walks
from ..sources import text as T
from . import experiments, report
from .lineage import cut, cut_by, shared_folder
from .queries import _E, _H, SEED, _vectors, copurchase, query, raw_edges, table


def _file(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _written(lines: DataFrame) -> str:
    path = _file(lines.sparkSession)
    T.write_lines(lines, path)
    return path


def _items(df: DataFrame, col: str) -> DataFrame:
    return df.select("id", F.posexplode(col).alias("j", "x")).select("id", F.col("j").cast("long").alias("j"), F.col("x").cast("double").alias("x"))


@query("SELECT l_partkey AS u, l_suppkey AS v FROM lineitem")
def file_edges(spark, d):
    """Edge lines as they come, malformed ones among them, which lenient reading leaves out."""
    bad = spark.range(50).select(F.concat(F.lit("x"), F.col("id").cast("string"), F.lit(" 1")).alias("value")).unionByName(spark.range(5).select(F.lit(" ").alias("value")))
    return T.read_edges(spark, _written(T.edge_lines(raw_edges(spark, d)).unionByName(bad)), "lenient").select("u", "v")


@query("SELECT u, v, (row_number() OVER (ORDER BY u, v) - 1) AS place FROM (SELECT DISTINCT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v FROM lineitem WHERE l_partkey <> l_suppkey)")
def file_sorted_edges(spark, d):
    """Sorted edge lines keep their order in the file."""
    read = T.read_edges(spark, _written(T.edge_lines(graph.canonical(raw_edges(spark, d)), ordered=True).coalesce(1)))
    return graph.number_rows(read, ["pos"], "place").select("u", "v", "place")


_PARTS = "SELECT p_partkey AS id, 0::BIGINT AS j, (p_size - 25) / 8.0::DOUBLE AS x FROM part UNION ALL SELECT p_partkey, 1, p_size * 0.5::DOUBLE FROM part"


def _part_vectors(spark, d, kind):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(((F.col("p_size") - 25) / 8.0).cast(kind), (F.col("p_size") * 0.5).cast(kind)).alias("v"))


@query(_PARTS)
def file_attributes(spark, d):
    lines = T.vector_lines(_part_vectors(spark, d, "float").withColumnRenamed("v", "x"), "f", "x")
    return _items(T.read_attributes(spark, _written(lines)), "x")


@query(_PARTS)
def file_vectors_exponent(spark, d):
    return _items(T.read_vectors(spark, _written(T.vector_lines(_part_vectors(spark, d, "double")))), "v")


@query(_PARTS)
def file_vectors_fixed(spark, d):
    return _items(T.read_vectors(spark, _written(T.vector_lines(_part_vectors(spark, d, "double"), "f"))), "v")


@query("SELECT c_custkey AS id, c_nationkey AS y FROM customer")
def file_labels(spark, d):
    """Labels written twice: the last line of an id wins."""
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("y"))
    both = T.label_lines(own.withColumn("y", F.lit(99))).coalesce(1).withColumn("o", F.lit(0)).unionByName(T.label_lines(own).coalesce(1).withColumn("o", F.lit(1)))
    return T.read_labels(spark, _written(both.coalesce(1).select("value")))


@query("""WITH c AS (SELECT c_custkey AS id, n_regionkey AS r, n_nationkey AS n FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT 0 AS depth, count(DISTINCT r)::INT AS children, 0 AS members, 0::BIGINT AS total, 0::BIGINT AS roots FROM c
UNION ALL SELECT 1, count(DISTINCT n)::INT, 0, 0, 1 FROM c GROUP BY r UNION ALL SELECT 2, 1, count(*)::INT, sum(id)::BIGINT, 0 FROM c GROUP BY r, n""")
def file_hierarchy(spark, d):
    """Records of a region, nation, customer hierarchy from its file; roots: whether the record's parent is the root."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    # Two labels a region at least, so that every inner record has children.
    nodes = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("id"), F.array(F.col("n_regionkey").cast("int"), F.col("n_nationkey").cast("int")).alias("path"))
    rec = cut(T.check_hierarchy(T.read_hierarchy(spark, _written(T.hierarchy_lines(nodes).coalesce(1)))))
    root = rec.where("depth = 0").select(F.col("pos").alias("parent"), F.lit(1).cast("long").alias("r"))
    members = F.coalesce("members", F.array().cast("array<long>"))
    return rec.join(root, "parent", "left").select("depth", "children", F.size(members).alias("members"), F.aggregate(members, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.coalesce("r", F.lit(0).cast("long")).alias("roots"))


@query("SELECT o_custkey AS a, o_orderkey AS b FROM orders")
def file_int_pairs(spark, d):
    rows = table(spark, d, "orders").select(F.concat_ws(",", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("value"))
    return T.read_int_pairs(spark, _written(rows.unionByName(spark.range(9).select(F.lit("7").alias("value")))))


@query("SELECT o_custkey AS a, o_orderkey AS b FROM orders")
def file_citations(spark, d):
    rows = table(spark, d, "orders").select(F.format_string("Cite(%d, %d)=1", "o_custkey", "o_orderkey").alias("value"))
    return T.parse_citations(T.lines(spark, _written(rows.unionByName(spark.range(9).select(F.lit("Cite(a,b)=1").alias("value")))))).select("a", "b")


@query("SELECT c_custkey AS pid, c_mktsegment AS topic FROM customer")
def file_topics(spark, d):
    rows = table(spark, d, "customer").select(F.format_string("%s(%d)=1", "c_mktsegment", "c_custkey").alias("value"))
    return T.parse_topics(T.lines(spark, _written(rows.unionByName(spark.range(9).select(F.lit("no topic").alias("value")))))).select("pid", "topic")


@query("SELECT p_partkey AS pid, 'size' AS k, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, p_brand, 0.5 FROM part")
def file_features(spark, d):
    rows = table(spark, d, "part").select(F.format_string("%d;x;size:%d,%s:0.5,bad,worse:x", "p_partkey", "p_size", "p_brand").alias("value"))
    got = T.parse_features(T.lines(spark, _written(rows.unionByName(spark.range(9).select(F.lit("bad;row").alias("value"))))))
    return got.select("pid", F.explode("feats").alias("f")).select("pid", "f.k", "f.v")


_RESULTS = "SELECT c_mktsegment AS dataset, o_orderstatus AS method, round(avg(o_totalprice), 2) AS total, NULL::DOUBLE AS link_auc FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderstatus"


def _results(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    rows = c.join(o, c["c_custkey"] == o["o_custkey"]).groupBy(F.col("c_mktsegment").alias("dataset"), F.col("o_orderstatus").alias("method")).agg(F.round(F.avg("o_totalprice"), 2).alias("total_time_sec"))
    made = [c.split() for c in T.RESULT.split(", ")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in made])


@query(_RESULTS)
def file_results(spark, d):
    """Result rows of two runs in one folder, without the rows of the build step; blanks are nulls."""
    path, rows = _file(spark), _results(spark, d)
    T.write_results(rows.where("method = 'F'"), path)
    T.write_results(rows.where("method <> 'F'").unionByName(rows.withColumn("method", F.lit("compile"))), path, append=True)
    return T.read_results(spark, [path]).unionByName(T.read_results_if_any(spark, path + "-none")).select("dataset", "method", F.col("total_time_sec").alias("total"), "link_auc")


@query(_RESULTS)
def file_results_one_header(spark, d):
    """The same rows as one file under one header."""
    return T.read_results(spark, [_written(T.result_lines(_results(spark, d)))]).select("dataset", "method", F.col("total_time_sec").alias("total"), "link_auc")


@query("""WITH f AS (SELECT id, min((o, l, side)) AS f FROM (SELECT l_partkey AS id, l_orderkey AS o, l_linenumber AS l, 0 AS side FROM lineitem
  UNION ALL SELECT l_suppkey, l_orderkey, l_linenumber, 1 FROM lineitem) GROUP BY id) SELECT row_number() OVER (ORDER BY f, id) - 1 AS new, id AS old FROM f""")
def file_renumber_map(spark, d):
    """The map of a renumbering, written and read as pairs."""
    names, _ = graph.renumber(raw_edges(spark, d), ["l_orderkey", "l_linenumber"])
    return T.read_edges(spark, _written(T.map_lines(names))).select(F.col("u").alias("new"), F.col("v").alias("old"))


@query(f"SELECT u, v FROM range(200) a(u), range(200) b(v) WHERE u < v AND {_H.format("'42:' || u || ':' || v")} / 4503599627370496.0 < CASE WHEN (u >= 100) = (v >= 100) THEN 0.08 ELSE 0.01 END")
def planted_edges(spark, d):
    return T.planted_blocks(spark)[0]


@query("SELECT vec_id AS id, round(CASE WHEN z > 8 THEN 0.9997 WHEN z < -8 THEN 0.0003 ELSE 1 / (1 + exp(-z)) END, 9) AS s FROM (SELECT vec_id, embedding[1]::DOUBLE * 50 AS z FROM embeddings)")
def sigmoid_values(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(sigmoid(F.col("embedding")[0].cast("double") * 50), 9).alias("s"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding[1:6], lambda x: x::DOUBLE * 10) AS v FROM embeddings), e AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM v)
SELECT vec_id AS id, j - 1 AS j, round(e[j] / (list_sum(e) + 1e-12), 9) AS p, (list_position(e, list_max(e)) - 1)::INT AS best FROM e, range(1, 7) r(j)""")
def softmax_values(spark, d):
    v = F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double") * 10)
    made = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), softmax(v).alias("p"), argmax(v).alias("best"))
    return made.select("id", F.posexplode("p").alias("j", "p"), "best").select("id", F.col("j").cast("long").alias("j"), F.round("p", 9).alias("p"), "best")


@query("SELECT vec_id AS id, round(embedding[1]::DOUBLE + 2.5 * embedding[2]::DOUBLE, 9) AS a, round(3 * embedding[1]::DOUBLE - embedding[2]::DOUBLE, 9) AS m FROM embeddings")
def axpy_and_product(spark, d):
    x, y = (F.array(F.col("embedding")[i].cast("double")) for i in (0, 1))
    two = F.transform(F.slice("embedding", 1, 2), lambda z: z.cast("double"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(add_scaled(x, y, 2.5)[0], 9).alias("a"), F.round(mat_vec([[3.0, -1.0]], two)[0], 9).alias("m"))


@query("SELECT o_orderkey AS id, (s // 3600) || 'h' || (s // 60 % 60) || 'm' || (s % 60) || 's' AS duration FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS s FROM orders)")
def duration_texts(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), duration_text("o_totalprice").alias("duration"))


@query("""WITH c AS (SELECT s_nationkey % 9 / 10.0 AS l, s_suppkey % 9 / 10.0 AS b, max(s_acctbal) / 10000 AS acc, min(s_acctbal) / 10000 AS auc FROM supplier GROUP BY 1, 2)
SELECT round(l, 1) AS lambda, round(b, 1) AS beta, round(0.7 * acc + 0.3 * auc, 9) AS weighted_score, row_number() OVER (ORDER BY 0.7 * acc + 0.3 * auc DESC, l, b) AS place FROM c""")
def sweep_order(spark, d):
    """Cells of a sweep in the order of their scores; the grid of lambda and beta is given as text."""
    grid = ",".join(str(x / 10) for x in range(9))
    lams, betas = (spark.createDataFrame([(float(x), i) for i, x in enumerate(experiments.parse_grid(grid))], f"{n} double, {n}_i int") for n in ("lambda", "beta"))
    s = table(spark, d, "supplier").withColumn("lambda_i", F.col("s_nationkey") % 9).withColumn("beta_i", (F.col("s_suppkey") % 9).cast("int"))
    cells = s.join(lams, "lambda_i").join(betas, "beta_i").groupBy("lambda", "beta").agg((F.max("s_acctbal") / 10000).alias("node_accuracy_mean"), (F.min("s_acctbal") / 10000).alias("link_auc"))
    ranked = experiments.ranked_sweep(cells).coalesce(1).withColumn("at", F.monotonically_increasing_id())
    return ranked.select("lambda", "beta", F.round("weighted_score", 9).alias("weighted_score"), (F.col("at") + 1).alias("place"))


@query("""WITH r AS (SELECT n_name, count(*) AS n, round(avg(s_acctbal), 2) AS mean FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name), p AS (SELECT *, row_number() OVER (ORDER BY n_name) + 1 AS line FROM r)
SELECT 0::BIGINT AS line, '| nation | suppliers | mean |' AS value UNION ALL SELECT 1, '|---|---|---|' UNION ALL SELECT line, '| ' || n_name || ' | ' || n || ' | ' || printf('%.6f', mean) || ' |' FROM p""")
def markdown_lines(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).groupBy(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.avg("s_acctbal"), 2).alias("mean")).orderBy("nation")
    return spark.createDataFrame(list(enumerate(report.markdown_table(rows).split("\n"))), "line long, value string")


@query("""WITH g AS (SELECT n_regionkey AS y, s_nationkey % 5 AS x, count(*)::DOUBLE AS m FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2), b AS (SELECT min(m) AS lo, max(m) AS hi FROM g),
c AS (SELECT y.y, x.x, coalesce(g.m, 0) AS m FROM (SELECT DISTINCT y FROM g) y CROSS JOIN (SELECT DISTINCT x FROM g) x LEFT JOIN g USING (y, x))
SELECT count(*) AS cells, sum(CASE WHEN m = hi THEN 1 ELSE 0 END)::BIGINT AS top FROM c, b""")
def heatmap_cells(spark, d):
    """Cells of the picture and those in the ramp's last colour."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    cells = s.join(n, s["s_nationkey"] == n["n_nationkey"]).groupBy(F.col("n_regionkey").alias("lambda"), (F.col("s_nationkey") % 5).alias("beta")).agg(F.count(F.lit(1)).cast("double").alias("m"))
    svg = report.heatmap_svg(cells, "m")
    return spark.createDataFrame([(svg.count("<rect "), svg.count(f'fill="{report.ramp(1.0, 0.0, 1.0)}"'))], "cells long, top long")


@query("SELECT 5::BIGINT AS groups, (SELECT count(DISTINCT o_orderstatus) * 5 FROM orders)::BIGINT AS bars FROM range(1)")
def bar_counts(spark, d):
    pivot = experiments.method_pivot(_results(spark, d), "total_time_sec", ["F", "O", "P"])
    svg = report.bars_svg(pivot)
    return spark.createDataFrame([(svg.count('font-size="12"'), svg.count("<rect "))], "groups long, bars long")


@query("SELECT count(*) AS nodes, (SELECT count(DISTINCT quality) FROM labels) AS classes FROM embeddings JOIN labels ON vec_id = doc_id WHERE quality IS NOT NULL")
def common_nodes(spark, d):
    """Nodes with a vector and a label: those that a node evaluation uses."""
    labels = table(spark, d, "labels").where("quality is not null").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    got = node_eval.eval_node(_vectors(spark, d), labels, runs=0)
    return got.select(F.col("n_eval_nodes").alias("nodes")).withColumn("classes", F.lit(labels.select("y").distinct().count()).cast("long"))


_SPLIT = f"""s AS (SELECT id, c, e, r < n // 2 AS train FROM (SELECT vec_id AS id, dense_rank() OVER (ORDER BY label) - 1 AS c, embedding::DOUBLE[] AS e,
 row_number() OVER (ORDER BY {_H.format("'42:0:' || vec_id")}, vec_id) - 1 AS r, count(*) OVER () AS n FROM embeddings)),
k AS (SELECT DISTINCT c FROM s), t AS (SELECT count(*)::DOUBLE AS n FROM s WHERE train),
l AS (SELECT c, (count(*) FILTER (WHERE s.c = k.c) - count(*) / (SELECT count(*) FROM k)::DOUBLE) / (SELECT n FROM t) * 0.1 AS b FROM k, s WHERE train GROUP BY k.c),
w AS (SELECT k.c, j, (sum(e[j]) FILTER (WHERE s.c = k.c) - sum(e[j]) / (SELECT count(*) FROM k)::DOUBLE) / (SELECT n FROM t) * 0.1 AS w FROM k, s, range(1, 65) r(j) WHERE train GROUP BY k.c, j)"""


@query(f"""WITH {_SPLIT.replace("SELECT c, (count", "SELECT k.c, (count")} SELECT w.c::BIGINT AS c, j - 1 AS j, round(coalesce(w, 0), 9) AS w, round(coalesce(b, 0), 9) AS b FROM w JOIN l USING (c)""")
def softmax_first_epoch(spark, d):
    """Weights and biases of the first epoch from zero, over the training half."""
    e = table(spark, d, "embeddings")
    names = graph.dense_ids(e, "label")
    rows = e.join(names, e["label"] == names["old"]).select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.col("new").cast("int").alias("c"))
    w, b = node_eval.train_softmax(cut(node_eval.rank_split(rows, 0.5, SEED, 0)).where("train"), names.count(), 64, epochs=1)
    return spark.createDataFrame([(c, j, round(float(w[j, c]), 9) + 0.0, round(float(b[c]), 9) + 0.0) for c in range(w.shape[1]) for j in range(64)], "c long, j long, w double, b double")


@query(f"""WITH {_SPLIT.replace("SELECT c, (count", "SELECT k.c, (count")}, z AS (SELECT s.id, s.c AS y, w.c, sum(e[j] * coalesce(w, 0)) + any_value(coalesce(b, 0)) AS z FROM s, w JOIN l USING (c) WHERE NOT train GROUP BY s.id, s.c, w.c),
p AS (SELECT id, any_value(y) AS y, arg_max(c, z) AS p FROM z GROUP BY id)
SELECT round(avg((y = p)::INT::DOUBLE), 9) AS accuracy_mean, 0.0::DOUBLE AS accuracy_std, (SELECT count(*) FROM s) AS n_eval_nodes FROM p""")
def node_eval_first_epoch(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("y"))
    return node_eval.eval_node(_vectors(spark, d), labels, runs=1, epochs=1).select(F.round("accuracy_mean", 9).alias("accuracy_mean"), "accuracy_std", "n_eval_nodes")


def _cliques(spark, d):
    """Customers in blocks of five neighbouring keys, all pairs of a block linked: communities that every strategy must find."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("u"))
    pairs = c.select("u", F.explode(F.sequence(F.col("u") + 1, F.col("u") + 4)).alias("v")).where("floor(u / 5) = floor(v / 5)")
    known = pairs.join(c.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v")
    return known.withColumn("pos", F.col("u") * 10 + F.col("v") - F.col("u"))


_BLOCKS = "SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_custkey // 5) AS comm{} FROM customer"


def _first_level(nodes: DataFrame, own: DataFrame) -> DataFrame:
    """Ids below the greatest without edges are nodes of a hierarchy too; only the table's own are kept."""
    named = cut(nodes.join(own, "id", "left_semi").select("id", F.get("path", F.lit(0)).alias("label"), F.size("path").alias("depth")))
    first = named.groupBy("label").agg(F.min("id").alias("comm"))
    return named.join(first, "label").select("id", "comm", "depth")


def _find_cliques(strategy: str, sql: str = _BLOCKS.format(", 1 AS depth")):
    def run(spark, d):
        attrs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array((F.floor(F.col("c_custkey") / 5) % 7 - 3).cast("float"), F.lit(1.0).cast("float")).alias("x"))
        return _first_level(hierarchy.build_hierarchy(_cliques(spark, d), strategy, attrs if strategy == "4" else None, 0.2), attrs.select("id"))

    run.__name__ = {"1": "cliques_multi_level", "2": "cliques_one_level", "3": "cliques_label_propagation", "4": "cliques_attributed"}[strategy]
    return query(sql)(run)


for _s in "1234":
    _find_cliques(_s)


@query(f"WITH {_E} n AS (SELECT DISTINCT src FROM adj) SELECT count(*) AS nodes, true AS better FROM n")
def louvain_distributed_gain(spark, d):
    """Nodes of a distributed level, and whether its modularity is above that of nodes on their own."""
    adj = cut_by(graph.symmetric(copurchase(spark, d)), "dst")
    nodes = cut(adj.select(F.col("src").alias("id")).distinct())
    found = cut(partition.louvain_distributed(adj, nodes, levels=1, passes=2))
    best, alone = (graph.modularity(adj, x).first()[0] for x in (found, nodes.withColumn("comm", F.col("id"))))
    return spark.createDataFrame([(found.select("id").distinct().count(), best > alone)], "nodes long, better boolean")


@query("SELECT count(DISTINCT c_custkey // 5) AS communities, true AS better, true AS split FROM customer")
def hierarchy_levels(spark, d):
    """Blocks chained to each other: communities of the first level, and whether its modularity is at least that of one level of moves."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("u"))
    chain = c.where("u % 5 = 4").withColumn("v", F.col("u") + 1).join(c.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v", (F.col("u") * 10 + 9).alias("pos"))
    e = cut(_cliques(spark, d).unionByName(chain))
    adj = cut(graph.symmetric(e))
    levels = {s: cut(hierarchy.build_hierarchy(e, s, max_depth=1).select("id", F.get("path", F.lit(0)).cast("long").alias("comm"))) for s in "12"}
    many, one = (graph.modularity(adj, levels[s]).first()[0] for s in "12")
    # With several levels neighbouring blocks may merge; one level of moves finds the blocks themselves.
    found = levels["2"].select("comm").distinct().count()
    return spark.createDataFrame([(found, many >= one - 1e-9, many > 0.5)], "communities long, better boolean, split boolean")


_BIP = "SELECT DISTINCT o_custkey AS u, l_suppkey + 10000000 AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


def _bipartite(spark, d):
    from .queries import bipartite

    return cut(bipartite(spark, d))


@query(f"WITH e AS ({_BIP}), n AS (SELECT count(*) AS m FROM e) SELECT m - floor(m * 0.1)::BIGINT AS train, floor(m * 0.1)::BIGINT AS positive, floor(m * 0.1)::BIGINT AS negative, 0::BIGINT AS both, 0::BIGINT AS unknown, 0::BIGINT AS isolated, 0::BIGINT AS linked FROM n")
def link_split_counts(spark, d):
    """Sizes of a split, edges in both parts or in none, nodes without a training edge, negatives that are edges."""
    e = _bipartite(spark, d)
    train, pos, neg = (cut(x.select("u", "v")) for x in links.split_links(e, 0.1, 1.0, SEED))
    ends = lambda df: graph.used_nodes(df)
    row = (train.count(), pos.count(), neg.count(), train.join(pos, ["u", "v"], "left_semi").count(), e.join(train.unionByName(pos), ["u", "v"], "left_anti").count(),
           ends(e).join(ends(train), "id", "left_anti").count(), neg.join(e, ["u", "v"], "left_semi").count())
    return spark.createDataFrame([row], "train long, positive long, negative long, both long, unknown long, isolated long, linked long")


def _walk_counts(p, q):
    def run(spark, d):
        e = _bipartite(spark, d)
        w = cut(walks.random_walks(e, 2, 5, SEED, p, q))
        steps = w.select("walk_id", F.explode(F.zip_with(F.slice("nodes", 1, 4), F.slice("nodes", 2, 4), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))).alias("s")).select("s.src", "s.dst")
        known = steps.join(graph.symmetric(e).select("src", "dst"), ["src", "dst"], "left_semi").count()
        starts = w.groupBy(F.col("nodes")[0].alias("id")).count().where("count = 2").count()
        return spark.createDataFrame([(w.count(), starts, steps.count(), known)], "walks long, starts long, steps long, along_edges long")

    run.__name__ = "walk_counts" if p is None else "biased_walk_counts"
    return query(f"WITH e AS ({_BIP}), n AS (SELECT count(DISTINCT u) + count(DISTINCT v) AS n FROM e) SELECT 2 * n AS walks, n AS starts, 8 * n AS steps, 8 * n AS along_edges FROM n")(run)


_walk_counts(None, None)
_walk_counts(1.0, 0.5)


@query("SELECT count(*) AS vectors, count(*) AS normal, 16::BIGINT AS width FROM customer")
def skipgram_norms(spark, d):
    """Vectors of walks over the blocks: one a node, of length one."""
    v = walks.embed_walks(_cliques(spark, d), "node2vec", dim=16, walk_length=6, num_walks=2, window=2, epochs=1, negatives=2, p=1.0, q=0.5)
    n = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return v.agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.abs(n - 1) < 1e-6).alias("normal"), F.max(F.size("v")).cast("long").alias("width"))


@query("SELECT c_nationkey AS y, count(*) AS n FROM customer GROUP BY 1")
def group_files_to_labels(spark, d):
    """Membership pairs through their file to labels, attributes and counts, as in preparing a social data set."""
    from .prep import social

    c = table(spark, d, "customer")
    pair = lambda a, b: F.concat_ws(",", a.cast("string"), b.cast("string")).alias("value")
    ring = c.select(pair(F.col("c_custkey"), F.col("c_custkey") + 1))
    _, attrs, labels = social(spark, _written(ring), _written(c.select(pair(F.col("c_custkey"), F.col("c_nationkey") + 100))))
    names = c.select(F.col("c_nationkey").alias("nation")).distinct()
    # Groups are numbered in ascending order.
    order = graph.dense_ids(names, "nation").select(F.col("new").cast("int").alias("y"), F.col("old").alias("nation"))
    hot = attrs.where(F.aggregate("x", F.lit(0.0), lambda s, v: s + v) == 1.0)
    return labels.join(hot, "id").join(order, "y").groupBy(F.col("nation").alias("y")).agg(F.count(F.lit(1)).alias("n"))
