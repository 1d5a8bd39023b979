"""Recursive community hierarchy: all open subgraphs of a depth are solved in one job, and small ones down to their leaves at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, drop, written
from .graph import all_nodes, component_parts, dense_labels, symmetric
from .partition import Graph, label_propagation_distributed, louvain_distributed, random_partition, strategy

#: Edges up to which a subgraph is solved in one task.
EXACT_EDGES = 2_000_000
#: Edges up to which that task also solves all subgraphs below; between the two, subgraphs are dealt anew at each depth.
WHOLE_EDGES = 200_000


def build_hierarchy(edges: DataFrame, partition: str = "1", attrs: DataFrame | None = None, lam: float = 0.2, seed: int = 42, exact_edges: int = EXACT_EDGES, max_depth: int = 1_000, whole_edges: int = WHOLE_EDGES, stored: bool = False) -> DataFrame:
    """(id, path): one row a node, the labels of its communities from the root down; an empty path if the root is one community.

    ``edges`` has u, v and may have pos, the order that decides ties. Attributes (id, x) are used by partition 4. ``stored`` edges are
    those of a table that is written in ranges of (u, v): no second copy of them is made. A subgraph splits if it has more than one label; otherwise it is a leaf.
    """
    solve = strategy(partition)
    lam = max(0.0, lam)
    order = F.col("pos") if "pos" in edges.columns else F.xxhash64("u", "v")
    nodes = all_nodes(edges)
    if attrs is not None:
        nodes = nodes.join(attrs.select("id", F.transform("x", lambda v: v.cast("double")).alias("x")), "id", "left")
    else:
        nodes = nodes.withColumn("x", F.lit(None).cast("array<double>"))
    state = cut(nodes.withColumn("path", F.array().cast("array<int>")).withColumn("open", F.lit(True)))
    live, own = edges.select("u", "v", order.cast("long").alias("pos"), F.array().cast("array<int>").alias("path")), None
    if not stored:
        live = own = written(live, "zstd")
    for depth in range(max_depth):
        sizes = live.groupBy("path").count()
        big = [r["path"] for r in sizes.where(F.col("count") > exact_edges).collect()]  # few: each has over exact_edges edges
        run = _solver(solve, lam, seed, whole_edges, max_depth - depth)
        found = cut(_solved(live, state, run, lam, seed, big, partition, attrs, exact_edges, max_depth - depth, stored and not depth))
        state = cut(state.join(found, "id", "left").select(
            "id", "x", F.concat("path", F.coalesce("below", F.array().cast("array<int>"))).alias("path"), F.coalesce("more", F.lit(False)).alias("open")))
        ends = state.where("open").select("id", "path")
        if ends.isEmpty():
            break
        a, b = ends.select(F.col("id").alias("u"), F.col("path").alias("pu")), ends.select(F.col("id").alias("v"), F.col("path").alias("pv"))
        before, live = own, written(live.drop("path").join(a, "u").join(b, "v").where("pu = pv").select("u", "v", "pos", F.col("pu").alias("path")), "zstd")
        own = live
        if before is not None:
            drop(before)
        if live.isEmpty():
            break
    if own is not None:
        drop(own)
    return state.select("id", "path")


def _solved(live: DataFrame, state: DataFrame, run, lam: float, seed: int, big: list, partition: str, attrs: DataFrame | None, exact_edges: int, levels: int, in_ranges: bool) -> DataFrame:
    """(id, below, more) of every node in a subgraph that has edges: its labels below the subgraph, and whether what they name is still to be solved."""
    key = lambda df: df.withColumn("gid", F.array_join(F.transform("path", lambda p: p.cast("string")), "/"))
    is_big = F.col("path").isin([]) if not big else F.array_contains(F.array(*[F.array(*[F.lit(int(p)) for p in path]).cast("array<int>") for path in big]), F.col("path"))
    small_edges, nodes = key(live.where(~is_big) if big else live).select("gid", "u", "v", "pos"), key(state.where("open")).select("gid", "id", "x")
    with_edges = nodes.join(small_edges.select("gid").distinct(), "gid", "left_semi")
    out = with_edges.groupBy("gid").cogroup(small_edges.groupBy("gid")).applyInArrow(run, "id long, below array<int>, more boolean")
    for path in big:
        same = F.col("path") == F.array(*[F.lit(int(p)) for p in path]).cast("array<int>")
        inside = live.where(same).select("u", "v", "pos")
        if partition != "0" and (found := _by_components(inside, state.where(same), strategy(partition), lam, seed, exact_edges, levels, attrs is not None, in_ranges)) is not None:
            out = out.unionByName(found)
            continue
        members, adj = cut(state.where(same).select("id")), symmetric(inside.select("u", "v"))
        if partition in ("3", "4"):
            adj = cut(adj)
        if partition == "0":
            found = random_partition(members, seed)
        elif partition == "3":
            found = label_propagation_distributed(adj, members, seed=seed)
        else:
            found = louvain_distributed(adj, members, attrs if partition == "4" else None, lam, levels=1 if partition in ("2", "4") else None, seed=seed)
        found = cut(found.select("id", F.col("comm").cast("int").alias("label")))
        if found.select("label").distinct().limit(2).count() > 1:
            out = out.unionByName(found.select("id", F.array("label").alias("below"), F.lit(True).alias("more")))
    return out


def _by_components(edges: DataFrame, members: DataFrame, solve, lam: float, seed: int, exact_edges: int, levels: int, attributed: bool, in_ranges: bool) -> DataFrame | None:
    """(id, below, more) of a large subgraph whose components are small enough for a task each; none if one is not.

    No move leaves a component, so components are solved on their own, with the weight of the whole subgraph in their gains. Each stops by itself.
    """
    parts = component_parts(edges, in_ranges=in_ranges)
    sizes = parts.groupBy("part").agg(F.sum(F.size("u").cast("long")).alias("n"))
    most, n = sizes.agg(F.max("n"), F.sum("n")).first()
    if most > exact_edges:
        drop(parts)
        return None
    nodes = None
    if attributed:
        ids = parts.select("part", F.explode(F.array_union("u", "v")).alias("id")).distinct()
        nodes = cut(ids.join(members.select("id", "x"), "id").select("part", "id", "x"))
    found = cut(_solve_components(parts, nodes, solve, 2 * n, lam, seed, levels))
    drop(parts)
    known = members.select("id").join(found, "id", "left").select("id", F.coalesce("comm", "id").alias("comm"), F.coalesce("below", F.array().cast("array<int>")).alias("below"))
    known = cut(known)
    named = dense_labels(known.select("id", "comm"))
    return known.select("id", "below").join(named, "id").select("id", F.concat(F.array(F.col("comm").cast("int")), "below").alias("below"), F.lit(False).alias("more"))


def local_graph(ids: np.ndarray, u: np.ndarray, v: np.ndarray, total: int | None = None) -> Graph:
    """Adjacency over places in the sorted ids, in input order; a raw self-loop is listed twice and weighs one."""
    a, b = (np.searchsorted(ids, x).astype("int32") for x in (u, v))
    ends, others = np.stack([a, b], 1).ravel(), np.stack([b, a], 1).ravel()
    order = np.argsort(ends, kind="stable")
    cuts = np.searchsorted(ends[order], np.arange(len(ids) + 1)).tolist()
    flat = np.arange(len(ids)).astype(object)[others[order]].tolist()  # one Python number a node, not one an edge
    loops = np.zeros(len(ids), "int64")
    loops[a[a == b]] = 1
    return Graph(rows=[flat[i:j] for i, j in zip(cuts, cuts[1:])], loops=loops.tolist(), total=total)


def _solver(solve, lam: float, seed: int, whole_edges: int, levels: int):
    """Solver of one subgraph: one level, or up to ``levels`` if it has at most ``whole_edges`` edges."""

    def run(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        order = np.argsort(nodes["id"].to_numpy())
        ids, x = nodes["id"].to_numpy()[order], _attributes(nodes, order)
        u, v = _in_order(*(edges[c].to_numpy() for c in ("u", "v", "pos")))
        all_levels = len(u) <= whole_edges
        below, _ = _labels(solve, ids, x, u, v, lam, seed, levels if all_levels else 1)
        more = not all_levels and bool(len(below) and below[0])
        return pa.table({"id": ids, "below": pa.array(below, pa.list_(pa.int32())), "more": np.full(len(ids), more)})

    return run


def _attributes(nodes: pa.Table, order: np.ndarray) -> list:
    x = nodes["x"].to_pylist()
    return [None if x[i] is None else np.asarray(x[i], float) for i in order.tolist()]


def _in_order(u: np.ndarray, v: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((v, u, pos))
    return u[order], v[order]


def _labels(solve, ids: np.ndarray, x: list, u: np.ndarray, v: np.ndarray, lam: float, seed: int, levels: int, total: int | None = None) -> tuple[list[list[int]], np.ndarray]:
    """Labels of every node below the subgraph and those of the first level; with ``total`` it is a component of a graph of that weight, whose first labels are kept though all are one."""
    below: list[list[int]] = [[] for _ in ids]
    first = np.zeros(len(ids), "int64")
    waiting = [(np.arange(len(ids)), np.searchsorted(ids, u), np.searchsorted(ids, v), levels, total)]
    while waiting:
        own, u, v, left, total = waiting.pop()
        labels = np.asarray(solve(local_graph(own, u, v, total), x=[x[i] for i in own.tolist()], lam=lam, seed=seed))
        if total is not None:
            first = labels
        elif (labels == labels[0]).all():
            continue
        for i, label in zip(own.tolist(), labels.tolist()):
            below[i].append(label)
        if left > 1:
            lu, lv = labels[np.searchsorted(own, u)], labels[np.searchsorted(own, v)]
            waiting += [(*part, left - 1, None) for part in _parts(own, labels, u, v, lu, lv)]
    return below, first


def _solve_components(parts: DataFrame, nodes: DataFrame | None, run_one, total: int, lam: float, seed: int, levels: int) -> DataFrame:
    """(id, comm, below) of the nodes of components, one a task: the least id of a node's community in the first level, and its labels below that."""

    def run(edges: pa.Table, held: pa.Table | None = None) -> pa.Table:
        flat = [np.concatenate([c.flatten().to_numpy() for c in edges[name].chunks] or [np.empty(0, "int64")]) for name in ("u", "v", "pos")]
        u, v = _in_order(*flat)
        flat.clear()
        ids = np.unique(np.r_[u, v])
        x = [None] * len(ids)
        if held is not None:
            x = _attributes(held, np.argsort(held["id"].to_numpy()))
        below, first = _labels(run_one, ids, x, u, v, lam, seed, levels, total)
        least = np.unique(first, return_index=True)
        comm = ids[least[1][np.searchsorted(least[0], first)]] if len(ids) else ids
        return pa.table({"id": ids, "comm": comm, "below": pa.array([b[1:] for b in below], pa.list_(pa.int32()))})

    schema = "id long, comm long, below array<int>"
    if nodes is None:
        return parts.groupBy("part").applyInArrow(lambda edges: run(edges), schema)
    return parts.groupBy("part").cogroup(nodes.groupBy("part")).applyInArrow(lambda edges, held: run(edges, held), schema)


def _parts(own: np.ndarray, labels: np.ndarray, u: np.ndarray, v: np.ndarray, lu: np.ndarray, lv: np.ndarray):
    """(nodes, u, v) of each label that has edges inside, in their order."""
    inside = np.flatnonzero(lu == lv)
    inside = inside[np.argsort(lu[inside], kind="stable")]
    names, first = np.unique(lu[inside], return_index=True)
    order = np.argsort(labels, kind="stable")
    sorted_labels = labels[order]
    for name, at in zip(names.tolist(), np.split(inside, first[1:])):
        lo, hi = np.searchsorted(sorted_labels, name), np.searchsorted(sorted_labels, name, side="right")
        yield own[order[lo:hi]], u[at], v[at]
