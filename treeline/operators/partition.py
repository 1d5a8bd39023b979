"""Community partition strategies.

``exact`` solvers run one subgraph in one task, visiting nodes in id order, moves taking effect at
once; they are for subgraphs below an edge threshold. ``*_distributed`` solvers are rounds of joins
and aggregates for subgraphs of any size: all nodes of one hash parity move together, and the best
assignment seen is kept.
"""

from __future__ import annotations

import random as _random
from collections import Counter
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import hash52
from ..functions.vectors import attribute_gain, structural_gain
from ..plans.lineage import cut, cut_by, drop, written
from .graph import attribute_sums, compose, dense_labels, modularity, neighbour_weights, weighted_degree
from .graph import whole as whole_task

#: Least gain of modularity that a pass or a level must bring, labels of the random strategy.
MIN_GAIN, RANDOM_LABELS = 0.005, 5
#: Passes of a solver without a modularity stop.
MAX_PASSES = 200
#: Neighbours of a node from which on its gains with attributes are computed as arrays.
WIDE = 64


class Graph:
    """A subgraph with local ids: per node its neighbours in input order (each weighing one) or its (neighbour, weight) list, self weight and degree.

    ``total`` is the weight of the graph that this one is a component of; a component's share of MIN_GAIN is its share of that weight.
    """

    def __init__(self, links: list[list[tuple[int, int]]] | None = None, loops: list[int] | None = None, total: int | None = None, rows: list[list[int]] | None = None):
        self.rows, self._links = rows, links
        self.degree = [len(row) for row in rows] if rows is not None else [sum(w for _, w in row) for row in links]
        self.loops = loops or [next((w for v, w in row if v == u), 0) for u, row in enumerate(self.links)]
        own = sum(self.degree)
        self.total = total or own
        self.least = MIN_GAIN * (own / self.total) if self.total else MIN_GAIN
        #: Neighbours without the node itself, where all weigh one.
        self.others = None if rows is None else [[v for v in row if v != u] if loop else row for u, (row, loop) in enumerate(zip(rows, self.loops))]

    def __len__(self) -> int:
        return len(self.degree)

    @property
    def links(self) -> list[list[tuple[int, int]]]:
        if self._links is None:
            self._links = [[(v, 1) for v in row] for row in self.rows]
        return self._links


class _Moves:
    """State of local moving: each node's community, internal and total weight, and attribute sums."""

    def __init__(self, g: Graph, x: list[np.ndarray | None] | None = None):
        n = len(g)
        self.g, self.x = g, x
        self.comm = list(range(n))
        self.inside = list(g.loops)
        self.tot = list(g.degree)
        self.size = [1] * n
        self.sums = [None if x is None or v is None else v.copy() for v in (x or [None] * n)]
        self.norms = None if x is None else [0.0 if v is None else float(np.sqrt(v @ v)) for v in x]
        self.arrays = x is not None and g.others is not None and len({v.shape for v in x if v is not None}) == 1
        if self.arrays:
            #: The same as arrays; attribute sums are rows of one.
            self.all_sums = np.zeros((n, *next(v for v in x if v is not None).shape))
            for u, v in enumerate(x):
                if v is not None:
                    self.all_sums[u] = v
                    self.sums[u] = self.all_sums[u]
            self.comms, self.tots, self.sizes = np.arange(n), np.array(self.tot, float), np.ones(n)
            self.wide = {u: np.asarray(row, "int32") for u, row in enumerate(g.others) if len(row) >= WIDE}

    def modularity(self) -> float:
        m2 = self.g.total
        return sum((i - t * t / m2) / m2 for i, t in zip(self.inside, self.tot) if t > 0)

    def around(self, u: int) -> dict[int, int]:
        """Weight to each community near u in the order met, its own first."""
        if self.g.others is not None:
            found = Counter()
            found[self.comm[u]] = 0
            found.update(map(self.comm.__getitem__, self.g.others[u]))
            return found
        found = {self.comm[u]: 0}
        for v, w in self.g.links[u]:
            if v != u:
                found[self.comm[v]] = found.get(self.comm[v], 0) + w
        return found

    def shift(self, u: int, c: int, weight: int, sign: int) -> None:
        """Put u into community c (sign 1) or take it out (-1); ``weight`` is its weight to the community."""
        self.inside[c] += sign * (2 * weight + self.g.loops[u])
        self.tot[c] += sign * self.g.degree[u]
        self.size[c] += sign
        if self.x is not None and self.x[u] is not None:
            if self.sums[c] is None:
                self.sums[c] = self.all_sums[c] if self.arrays else np.zeros_like(self.x[u])
            self.sums[c] += sign * self.x[u]
        if self.arrays:
            self.tots[c], self.sizes[c] = self.tot[c], self.size[c]

    def likeness(self, u: int, c: int) -> float:
        if self.x is None or self.x[u] is None or self.sums[c] is None or self.size[c] <= 0:
            return 0.0
        mean = self.sums[c] / self.size[c]
        n = self.norms[u] * float(np.sqrt(mean @ mean))
        return float(self.x[u] @ mean) / n if n > 0 else 0.0

    def take_out(self, u: int, lam: float) -> dict[int, int]:
        """Takes u, of many neighbours, out of its community and gives the part of ``around`` that can be best: gains as arrays rule out what is
        further below the greatest than rounding reaches, so that ``sweep`` decides as if it had seen all."""
        own, deg = self.comm[u], self.g.degree[u]
        met = self.comms[self.wide[u]]
        if len(self.comm) <= 16 * len(met):
            weights = np.bincount(met, minlength=len(self.comm))
            weights[own] += 1  # it is always there
            near = np.flatnonzero(weights)
            weights = weights[near]
        else:
            near, weights = np.unique(np.r_[met, own], return_counts=True)
        weights[np.searchsorted(near, own)] -= 1
        weight = int(weights[np.searchsorted(near, own)])
        self.shift(u, own, weight, -1)
        gains = weights - self.tots[near] * deg / self.g.total
        if self.x[u] is not None and lam > 0:
            mean = self.all_sums[near] / np.maximum(self.sizes[near], 1)[:, None]
            n = self.norms[u] * np.sqrt((mean * mean).sum(1))
            like = np.divide((mean * self.x[u]).sum(1), n, out=np.zeros(len(near)), where=n > 0)
            gains += lam * np.where(self.sizes[near] > 0, like, 0.0)
        left = gains >= max(float(gains.max()), lam * self.likeness(u, own)) - 1e-12 * (1 + deg)
        found = {own: weight}
        found.update((c, w) for _, c, w in sorted((int((met == c).argmax()), c, w) for c, w in zip(near[left].tolist(), weights[left].tolist()) if c != own))
        return found

    def sweep(self, lam: float | None) -> int:
        """One pass over all nodes; number of moves. Without ``lam`` the integer structural gain decides."""
        m2, moves = self.g.total, 0
        for u in range(len(self.comm)):
            own = self.comm[u]
            if self.arrays and lam is not None and u in self.wide:
                near = self.take_out(u, lam)
            else:
                near = self.around(u)
                self.shift(u, own, near[own], -1)
            deg = self.g.degree[u]
            if lam is None:
                best, weight, top = own, 0, 0
                tot = self.tot
                for c, w in near.items():
                    gain = w * m2 - tot[c] * deg
                    if gain > top:
                        best, weight, top = c, w, gain
            else:
                best, weight, top = own, 0, lam * self.likeness(u, own)
                for c, w in near.items():
                    gain = w - self.tot[c] * deg / m2 + lam * self.likeness(u, c)
                    if gain > top:
                        best, weight, top = c, w, gain
            self.shift(u, best, weight, 1)
            self.comm[u] = best
            if self.arrays:
                self.comms[u] = best
            moves += best != own
        return moves


def _first_seen(labels: list[int]) -> list[int]:
    names: dict[int, int] = {}
    return [names.setdefault(c, len(names)) for c in labels]


def _contract(g: Graph, labels: list[int]) -> Graph:
    k = max(labels) + 1
    links: list[dict[int, int]] = [Counter() for _ in range(k)]
    if g.rows is not None:
        for u, row in enumerate(g.rows):
            links[labels[u]].update(map(labels.__getitem__, row))
    else:
        for u, row in enumerate(g.links):
            own = links[labels[u]]
            for v, w in row:
                own[labels[v]] = own.get(labels[v], 0) + w
    return Graph([list(row.items()) for row in links], total=g.total)


def _one_level(g: Graph) -> tuple[list[int], float]:
    state = _Moves(g)
    start = now = state.modularity()
    while True:
        moves, before = state.sweep(None), now
        now = state.modularity()
        if not moves or now - before <= g.least:
            return _first_seen(state.comm), now - start


def louvain_one_level(g: Graph, **_) -> list[int]:
    return _one_level(g)[0]


def louvain(g: Graph, **_) -> list[int]:
    labels = list(range(len(g)))
    while True:
        step, gain = _one_level(g)
        labels = [step[c] for c in labels]
        if gain < g.least:
            return _first_seen(labels)
        g = _contract(g, step)


def louvain_attributed(g: Graph, x: list | None = None, lam: float = 0.2, **_) -> list[int]:
    """One level; stops when nothing moves, after MAX_PASSES at the latest (no objective guarantees an end)."""
    state = _Moves(g, x or [None] * len(g))
    for _ in range(MAX_PASSES):
        if not state.sweep(max(0.0, lam)):
            break
    return _first_seen(state.comm)


def label_propagation(g: Graph, seed: int = 42, **_) -> list[int]:
    """Nodes in random order take the most frequent label around them if it beats their own, until a sweep changes none."""
    rnd, labels = _random.Random(seed), list(range(len(g)))
    order, changed = list(labels), True
    while changed:
        changed = False
        rnd.shuffle(order)
        for u in order:
            seen: dict[int, int] = {}
            for v, w in g.links[u]:
                seen[labels[v]] = seen.get(labels[v], 0) + w
            if not seen:
                continue
            most = max(seen.values())
            if most > seen.get(labels[u], 0):
                labels[u] = rnd.choice(sorted(c for c, k in seen.items() if k == most))
                changed = True
    return _first_seen(labels)


def random_labels(g: Graph, seed: int = 42, **_) -> list[int]:
    rnd = _random.Random(seed)
    return [rnd.randrange(min(RANDOM_LABELS, len(g))) for _ in range(len(g))]


#: Names of the strategies.
STRATEGIES: dict[str, Callable] = {"0": random_labels, "1": louvain, "2": louvain_one_level, "3": label_propagation, "4": louvain_attributed}


def strategy(name: str) -> Callable:
    if name not in STRATEGIES:
        raise ValueError(f"unknown partition {name!r}; one of {', '.join(STRATEGIES)}")
    return STRATEGIES[name]


def random_partition(nodes: DataFrame, seed: int, k: int = RANDOM_LABELS) -> DataFrame:
    """(id, comm) with a label below min(k, nodes) by hash."""
    n = nodes.count()
    return nodes.select("id", (hash52(seed, F.col("id")) % max(1, min(k, n))).alias("comm"))


def best_moves(adj: DataFrame, assign: DataFrame, attrs: DataFrame | None = None, lam: float = 0.0) -> DataFrame:
    """(id, own, comm, gain): the best community of every node as things stand; its own wins ties, then the smaller label.

    Structural gains are scaled by the total weight and exact integers; with attributes they are doubles.
    """
    m2 = adj.agg(F.sum("w")).first()[0] or 0
    near = neighbour_weights(adj, assign)
    deg = weighted_degree(adj)
    own = assign.select("id", F.col("comm").alias("own")).join(deg, "id")
    stats = own.groupBy(F.col("own").alias("comm")).agg(F.sum("degree").alias("tot"))
    cand = near.join(own, "id").join(stats, "comm")
    out = F.when(F.col("comm") == F.col("own"), F.col("degree")).otherwise(0)
    gain = structural_gain(F.col("w"), F.col("tot") - out, F.col("degree"), F.lit(m2).cast("long"))
    if attrs is not None and lam > 0:
        sums = attribute_sums(assign, attrs)
        cand = cand.join(sums, "comm").join(attrs, "id", "left")
        mine = F.col("comm") == F.col("own")
        total = F.when(mine & F.col("x").isNotNull(), F.zip_with("total", "x", lambda s, v: s - v.cast("double"))).otherwise(F.col("total"))
        size = F.col("size") - F.when(mine, 1).otherwise(0)
        like = attribute_gain(F.col("x"), total, size, lam)
        structural = gain.cast("double") / F.lit(float(m2))
        gain = F.when(mine, F.greatest(structural, F.lit(0.0))).otherwise(structural) + like
    ranked = cand.select("id", "own", "comm", gain.alias("gain"))
    best = F.max(F.struct("gain", (F.col("comm") == F.col("own")).alias("stay"), (-F.col("comm")).alias("least"))).alias("b")
    return ranked.groupBy("id", "own").agg(best).select("id", "own", (-F.col("b.least")).alias("comm"), F.col("b.gain").alias("gain"))


def louvain_distributed(adj: DataFrame, nodes: DataFrame, attrs: DataFrame | None = None, lam: float = 0.0, levels: int | None = None, passes: int | None = None, seed: int = 42) -> DataFrame:
    """(id, comm): multi-level local moving in rounds until a level gains less than MIN_GAIN; one level with attributes.

    A level ends when two passes gain no more than MIN_GAIN, so it always ends; with attributes after MAX_PASSES at the latest,
    as in one task. ``levels`` and ``passes`` stop it earlier.
    """
    if attrs is not None:
        levels, passes = 1, passes or MAX_PASSES
    whole = cut(nodes.select("id", F.col("id").alias("comm")))
    graph, own_table = adj, None
    for level in count() if levels is None else range(levels):
        rounds = _Rounds(graph) if attrs is None else _AttributedRounds(graph, attrs, lam)
        state = best = cut(rounds.members.select("id", F.col("id").alias("comm")))
        start = top = 0.0
        for turn in count():
            moves, now = rounds.moves(state)
            if not turn:
                start = top = now
            else:
                gained = now - top
                if now > top or attrs is not None:
                    best, top = state, now
                if not turn % 2 and gained <= MIN_GAIN:
                    break
            if turn == passes:
                break
            state = cut(moves.select("id", F.when((hash52(seed, level, turn, F.col("id"), portable=False) % 2 == 0) & (F.col("gain") > 0), F.col("comm")).otherwise(F.col("own")).alias("comm")))
        named, members = cut(dense_labels(best)), rounds.members
        whole = cut(compose(whole.join(members.withColumnRenamed("id", "comm"), "comm", "left_semi").select("id", "comm"), named).unionByName(
            whole.join(members.withColumnRenamed("id", "comm"), "comm", "left_anti").select("id", (-1 - F.col("id")).alias("comm"))))
        if top - start < MIN_GAIN or level + 1 == levels:
            break
        before, own_table = own_table, written(rounds.quotient(named), "zstd")
        if before is not None:
            drop(before)
        graph = own_table
    if own_table is not None:
        drop(own_table)
    return dense_labels(whole)


class _AttributedRounds:
    """Rounds with attributes, by joins and groupings of the adjacency."""

    def __init__(self, adj: DataFrame, attrs: DataFrame, lam: float):
        self.adj, self.attrs, self.lam = adj, attrs, lam
        self.members = cut(adj.select(F.col("src").alias("id")).distinct())

    def moves(self, state: DataFrame) -> tuple[DataFrame, float]:
        return best_moves(self.adj, state, self.attrs, self.lam), modularity(self.adj, state).first()[0] or 0.0


#: Adjacency entries of a block.
BLOCK_ENTRIES = 1_500_000


class _Rounds:
    """Rounds over an adjacency that lies in blocks: a range of (src, dst), compressed, and dealt once.

    A round brings to each block the communities of the nodes that occur in it, and takes from it the best move of each node. Nodes at a
    block's ends may go on in the next block, so the block gives their weights to all communities around, which are summed up first.
    """

    def __init__(self, adj: DataFrame, block_entries: int = BLOCK_ENTRIES):
        tasks = max(1, -(-adj.count() // block_entries))
        self.blocks = cut_by(adj.select("src", "dst", "w").repartitionByRange(tasks, "src", "dst").mapInArrow(_block, "block int, ids binary, n binary, at binary, w binary, ghosts binary"), "block")
        self.needs = cut_by(self.blocks.mapInArrow(_occurring, "block int, id long"), "id")
        self.degree = cut(self.blocks.mapInArrow(_degrees, "id long, degree long, loop long").groupBy("id").agg(F.sum("degree").alias("degree"), F.sum("loop").alias("loop")))
        self.m2, self.loops = (x or 0 for x in self.degree.agg(F.sum("degree"), F.sum("loop")).first())
        self.members = self.degree.select("id")

    def moves(self, state: DataFrame) -> tuple[DataFrame, float]:
        """(id, own, comm, gain) as ``best_moves`` and the modularity of the state."""
        base = state.join(self.degree.select("id", "degree"), "id")
        totals = cut(base.groupBy("comm").agg(F.sum("degree").alias("tot")))
        around = self.needs.join(base.join(totals, "comm"), "id").select("block", "id", "comm", "degree", "tot")
        found = cut(self.blocks.groupBy("block").cogroup(around.groupBy("block")).applyInArrow(
            _best_in_block(self.m2), "id long, own long, comm long, gain long, inner long, w long, degree long, tot long, closed boolean"))
        rows = found.where("NOT closed").groupBy("id", "own", "comm", "degree", "tot").agg(F.sum("w").alias("w"))
        stay = F.col("comm") == F.col("own")
        gain = structural_gain(F.col("w"), F.col("tot") - F.when(stay, F.col("degree")).otherwise(0), F.col("degree"), F.lit(self.m2).cast("long"))
        best = F.max(F.struct(gain.alias("gain"), stay.alias("stay"), (-F.col("comm")).alias("least"))).alias("b")
        ends = rows.groupBy("id", "own").agg(best, F.sum(F.when(stay, F.col("w")).otherwise(0)).alias("inner"))
        moves = cut(found.where("closed").select("id", "own", "comm", "gain", "inner").unionByName(ends.select("id", "own", (-F.col("b.least")).alias("comm"), F.col("b.gain").alias("gain"), "inner")))
        inside = (moves.agg(F.sum("inner")).first()[0] or 0) + self.loops
        squares = totals.agg(F.sum(F.col("tot").cast("double") * F.col("tot").cast("double"))).first()[0] or 0.0
        return moves, (inside - squares / self.m2) / self.m2 if self.m2 else 0.0

    def quotient(self, assign: DataFrame) -> DataFrame:
        around = self.needs.join(assign, "id").select("block", "id", "comm")
        return self.blocks.groupBy("block").cogroup(around.groupBy("block")).applyInArrow(_merged, "src long, dst long, w long").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _zip(a: np.ndarray) -> bytes:
    return a.nbytes.to_bytes(8, "little") + pa.compress(a.tobytes(), "zstd", asbytes=True)


def _unzip(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True), kind)


_KINDS = {"ids": "int64", "n": "int64", "at": "int32", "w": "int64", "ghosts": "int64"}


def _read_block(t: pa.Table | pa.RecordBatch, row: int = 0) -> list[np.ndarray]:
    return [_unzip(t[c][row].as_py(), kind) for c, kind in _KINDS.items()]


def _block(batches):
    t = whole_task(batches)
    if t is None:
        return
    src, dst, w = (t[c].to_numpy() for c in ("src", "dst", "w"))
    order = np.lexsort((dst, src))
    src, dst, w = src[order], dst[order], w[order]
    first = np.flatnonzero(np.r_[True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])])
    src, dst, w = src[first], dst[first], np.add.reduceat(w, first)
    ids, n = np.unique(src, return_counts=True)
    ghosts, at = np.unique(dst, return_inverse=True)
    parts = [ids, n, at.astype("int32"), w, ghosts]
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *[pa.array([_zip(x.astype(k))], pa.binary()) for x, k in zip(parts, _KINDS.values())]], ["block", *_KINDS])


def _occurring(batches):
    for b in batches:
        for row in range(b.num_rows):
            ids, _, _, _, ghosts = _read_block(b, row)
            every = np.union1d(ids, ghosts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(every), b["block"][row].as_py(), "int32")), pa.array(every)], ["block", "id"])


def _degrees(batches):
    for b in batches:
        for row in range(b.num_rows):
            ids, n, at, w, ghosts = _read_block(b, row)
            degree, loop = np.zeros(len(ghosts), "int64"), np.zeros(len(ghosts), "int64")
            np.add.at(degree, at, w)
            same = ghosts[at] == np.repeat(ids, n)
            np.add.at(loop, at[same], w[same])
            yield pa.RecordBatch.from_arrays([pa.array(ghosts), pa.array(degree), pa.array(loop)], ["id", "degree", "loop"])


def _best_in_block(m2: int):
    names_out = ["id", "own", "comm", "gain", "inner", "w", "degree", "tot", "closed"]

    def run(block: pa.Table, around: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({c: pa.array([], pa.bool_() if c == "closed" else pa.int64()) for c in names_out})
        ids, n, at, w, ghosts = _read_block(block)
        order = np.argsort(around["id"].to_numpy())
        known, comm, degree, tot = (around[c].to_numpy()[order] for c in ("id", "comm", "degree", "tot"))
        names, code = np.unique(comm, return_inverse=True)
        tot_of = np.zeros(len(names), "int64")
        tot_of[code] = tot
        mine = np.searchsorted(known, ids)
        own_code, deg = code[mine], degree[mine]
        row = np.repeat(np.arange(len(ids)), n)
        other = ghosts[at] != ids[row]
        key = np.r_[row[other] * len(names) + code[np.searchsorted(known, ghosts)][at[other]], np.arange(len(ids)) * len(names) + own_code]
        order = np.argsort(key, kind="stable")
        key, sums = key[order], np.r_[w[other], np.zeros(len(ids), "int64")][order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sums = np.add.reduceat(sums, first)
        r, c = np.divmod(key[first], len(names))
        own = c == own_code[r]
        gain = sums * m2 - (tot_of[c] - np.where(own, deg[r], 0)) * deg[r]
        starts = np.searchsorted(r, np.arange(len(ids)))
        top = np.maximum.reduceat(gain, starts)
        pick = np.minimum.reduceat(np.where(gain == top[r], np.where(own, -1, c), len(names)), starts)
        best = np.where(pick < 0, own_code, pick)
        mid, ends = slice(1, len(ids) - 1), (r == 0) | (r == len(ids) - 1)
        e, k = r[ends], len(ids[mid])
        none = lambda m: np.zeros(m, "int64")
        cols = [(ids[mid], ids[e]), (names[own_code[mid]], names[own_code[e]]), (names[best[mid]], names[c[ends]]), (top[mid], none(len(e))), (sums[own][mid], none(len(e))),
                (none(k), sums[ends]), (deg[mid], deg[e]), (none(k), tot_of[c[ends]]), (np.ones(k, bool), np.zeros(len(e), bool))]
        return pa.table({name: np.concatenate(x) for name, x in zip(names_out, cols)})

    return run


def _merged(block: pa.Table, around: pa.Table) -> pa.Table:
    if not block.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("src", "dst", "w")})
    ids, n, at, w, ghosts = _read_block(block)
    order = np.argsort(around["id"].to_numpy())
    known, comm = around["id"].to_numpy()[order], around["comm"].to_numpy()[order]
    names, code = np.unique(comm, return_inverse=True)
    key = np.repeat(code[np.searchsorted(known, ids)], n) * len(names) + code[np.searchsorted(known, ghosts)][at]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    a, b = np.divmod(key[first], len(names))
    return pa.table({"src": names[a], "dst": names[b], "w": np.add.reduceat(w[order], first)})


def label_round(adj: DataFrame, assign: DataFrame, seed: int | None = None) -> DataFrame:
    """(id, comm) after one synchronous round: the most frequent label if it beats the own one; ties go to the smaller label, or by hash with a seed."""
    seen = adj.join(assign.select(F.col("id").alias("dst"), "comm"), "dst").groupBy(F.col("src").alias("id"), "comm").agg(F.sum("w").alias("k"))
    tie = -F.col("comm") if seed is None else hash52(seed, F.col("id"), F.col("comm"), portable=False)
    both = seen.join(assign.select("id", F.col("comm").alias("own")), "id")
    top = both.groupBy("id", "own").agg(F.max(F.struct("k", tie.alias("tie"), "comm")).alias("b"), F.max(F.when(F.col("comm") == F.col("own"), F.col("k")).otherwise(0)).alias("mine"))
    moved = top.select("id", F.when(F.col("b.k") > F.col("mine"), F.col("b.comm")).otherwise(F.col("own")).alias("comm"))
    return assign.select("id", F.col("comm").alias("old")).join(moved, "id", "left").select("id", F.coalesce("comm", "old").alias("comm"))


def label_propagation_distributed(adj: DataFrame, nodes: DataFrame, rounds: int | None = None, seed: int = 42) -> DataFrame:
    """(id, comm): rounds in which half of the nodes take their label of ``label_round``, until no node would change; ``rounds`` stops it earlier."""
    state = cut(nodes.select("id", F.col("id").alias("comm")))
    for turn in count() if rounds is None else range(rounds):
        new = label_round(adj, state, seed + turn).withColumnRenamed("comm", "new")
        turns = hash52(seed, turn, F.col("id"), portable=False) % 2 == 0
        both = cut(state.join(new, "id").withColumn("next", F.when(turns, F.col("new")).otherwise(F.col("comm"))))
        changed = both.where("comm <> new").limit(1).count()
        state = both.select("id", F.col("next").alias("comm"))
        if not changed:
            break
    return dense_labels(cut(state))
