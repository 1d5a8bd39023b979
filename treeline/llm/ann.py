"""Operator 9: nearest neighbours by vantage-point trees, one a shard.

Rows are dealt to shards of about ``SHARD_ROWS`` by a hash of their id; each shard's tree is built
once and kept as one row of the index (a checkpoint in the shared folder, so a lost executor loses
no index). Queries go through all trees in blocks of ``QUERY_BLOCK``: a block is one row, which is dealt to
each shard by a join on the shard, so one plan answers all blocks and the driver holds none. A node is left out for a query if the triangle inequality puts all its points
beyond ``tau / factor``, tau being the query's tenth nearest so far; factor 1 is exact, a larger one
searches less. The shards' answers (k a query and shard) are merged by rank.

Distances are summed in double precision over the components in order. Null ids, null vectors,
zero vectors, vectors holding null or non-finite components or with another length than most take
no part. Ties go to the smaller id; repeated ids count one by one, as candidates and as queries (each gets k rows of its own);
no row with a query's own id is a candidate. Other columns, whatever their names, are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARD_ROWS, LEAF_ROWS, QUERY_BLOCK = 20_000, 256, 4_096


class Tree:
    """A vantage-point tree over the rows of a shard, in arrays; leaves are runs of rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.lexsort((ids,))
        self.ids, self.x = ids[order], x[order]
        self.nodes: list[tuple] = []
        perm = np.arange(len(ids))
        self.root = self._build(perm, 0, len(perm), leaf)
        self.ids, self.x = self.ids[perm], self.x[perm]

    def _build(self, perm: np.ndarray, lo: int, hi: int, leaf: int) -> int:
        """Index of the node over perm[lo:hi]: (lo, hi, vantage point, ((min, max, child), (min, max, child)) or None)."""
        me = len(self.nodes)
        self.nodes.append(None)
        if hi - lo <= leaf:
            self.nodes[me] = (lo, hi, None, None)
            return me
        own = perm[lo:hi]
        point = self.x[own[np.argmax(distances(self.x[own[:1]], self.x[own])[0])]]
        d = distances(point[None], self.x[own])[0]
        order = np.argsort(d, kind="stable")
        perm[lo:hi] = own[order]
        d, mid = d[order], (hi - lo) // 2
        near = self._build(perm, lo, lo + mid, leaf)
        far = self._build(perm, lo + mid, hi, leaf)
        self.nodes[me] = (lo, hi, point, ((d[0], d[mid - 1], near), (d[mid], d[-1], far)))
        return me

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest of each query, padded with infinity."""
        found = np.full((len(q), k), np.inf)
        names = np.full((len(q), k), np.iinfo(np.int64).max)
        home = np.full(len(q), -1)

        def scan(node: int, who: np.ndarray) -> None:
            lo, hi = self.nodes[node][:2]
            d = distances(q[who], self.x[lo:hi])
            d[qid[who][:, None] == self.ids[None, lo:hi]] = np.inf
            both = np.concatenate([found[who], d], axis=1)
            ids = np.concatenate([names[who], np.broadcast_to(self.ids[lo:hi], d.shape)], axis=1)
            ids = np.where(np.isinf(both), np.iinfo(np.int64).max, ids)
            order = np.lexsort((ids, both), axis=1)[:, :k]
            found[who] = np.take_along_axis(both, order, 1)
            names[who] = np.take_along_axis(ids, order, 1)

        def bounds(node: int, who: np.ndarray) -> list[np.ndarray]:
            _, _, point, children = self.nodes[node]
            d = distances(q[who], point[None])[:, 0]
            return [np.maximum(0, np.maximum(a - d, d - b)) for a, b, _ in children]

        def descend(node: int, who: np.ndarray) -> None:
            """Each query first scans one near leaf, which gives it its first tau."""
            if not len(who):
                return
            children = self.nodes[node][3]
            if children is None:
                home[who] = node
                scan(node, who)
                return
            near, far = bounds(node, who)
            descend(children[0][2], who[near <= far])
            descend(children[1][2], who[near > far])

        def visit(node: int, who: np.ndarray, bound: np.ndarray) -> None:
            # Rounding of a bound must not cut off a tie.
            who = who[bound * factor <= found[who, -1] * (1 + 1e-9)]
            children = self.nodes[node][3]
            if children is None:
                who = who[home[who] != node]
                if len(who):
                    scan(node, who)
            elif len(who):
                for (_, _, child), bound in zip(children, bounds(node, who)):
                    visit(child, who, bound)

        descend(self.root, np.arange(len(q)))
        visit(self.root, np.arange(len(q)), np.zeros(len(q)))
        return names, found


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances, q rows x x rows, each summed over the components in order."""
    total = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        total += (q[:, j, None] - x[None, :, j]) ** 2
    return np.sqrt(total)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.coalesce(finite & some, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (common[0]["n"] if common else 0))


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding", query_condition=None) -> DataFrame:
    """Columns query_id, rank, vec_id, score: the k nearest of each query among all rows of ``vectors``.

    Queries are the rows of ``queries``, or of ``vectors`` that ``query_condition`` (on vec_id) holds for.
    """
    rows = usable(vectors, id_col, vec_col)
    total = rows.count()
    shards = max(1, -(-total // SHARD_ROWS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    trees = cut(dealt.groupBy("shard").applyInArrow(_plant, "shard int, tree binary"))
    asked = usable(queries, id_col, vec_col) if queries is not None else rows.where(query_condition)
    asked = cut(asked.withColumn("query", F.monotonically_increasing_id()))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    packs = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))).groupBy("block").applyInArrow(_pack, "block long, asked binary")
    dealt = packs.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(trees, "shard").select("asked", "tree")
    answers = dealt.mapInArrow(_ask(k, factor), "query long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pack(group: pa.Table) -> pa.Table:
    """The queries of a block as one row."""
    asked = (group["query"].to_numpy(), group["vec_id"].to_numpy(), np.array(group["v"].to_pylist(), float))
    return pa.table({"block": group["block"].slice(0, 1), "asked": pa.array([pickle.dumps(asked, 5)], pa.binary())})


def _plant(group: pa.Table) -> pa.Table:
    x = np.array(group["v"].to_pylist(), float)
    tree = Tree(group["vec_id"].to_numpy(), x)
    return pa.table({"shard": group["shard"].slice(0, 1), "tree": pa.array([pickle.dumps(tree, 5)], pa.binary())})


def _ask(k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for asked, tree in zip(b.column(0), b.column(1)):
                query, qid, q = pickle.loads(asked.as_buffer())
                names, found = pickle.loads(tree.as_buffer()).search(qid, q, k, factor)
                ok = np.isfinite(found)
                n = ok.sum(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(query, n)), pa.array(np.repeat(qid, n)), pa.array(names[ok]), pa.array(found[ok])], names=["query", "query_id", "vec_id", "score"])

    return run
