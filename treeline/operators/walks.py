"""Random walks and skip-gram baselines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import hash52, uniform
from ..plans.lineage import cut, cut_by, drop, written
from .graph import Sharing, list_batch, number_rows, portions, spread, symmetric, union_all, whole


#: Pairs of centre and context that one task trains on.
SHARD_PAIRS = 2_000_000


#: Neighbours of a node that lie in one row: a node with more has several rows, among which its neighbours are dealt by hash.
PIECE = 1_024
#: Most draws of a walker in one round.
DRAWS = 64


def neighbour_pieces(edges: DataFrame, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(src, h, dsts): neighbours of each node in rows of about ``piece``, dealt by (src, h), and (src, n, cap): its rows and the longest of them."""
    adj = symmetric(edges).where("src <> dst").select("src", "dst")
    deg = cut(adj.groupBy("src").agg(F.count(F.lit(1)).alias("deg")))
    entries = deg.agg(F.sum("deg")).first()[0] or 0
    large = deg.where(F.col("deg") > piece).select("src", F.ceil(F.col("deg") / piece).cast("int").alias("n"))
    some = large.count()
    keyed = adj.withColumn("h", F.lit(0))
    if some:
        # At most 100,000 rows are broadcast.
        keyed = adj.join(F.broadcast(large) if some <= 100_000 else large, "src", "left").select("src", "dst", _piece_of(F.col("dst"), F.coalesce("n", F.lit(1))).alias("h"))
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries // 1_000_000))
    pieces = cut_by(keyed.repartition(tasks, "src", "h").mapInArrow(_gather, "src long, h int, dsts array<long>"), "src", "h", ordered=True)
    caps = pieces.groupBy("src").agg(F.max(F.size("dsts")).alias("cap"))
    return pieces, cut(caps.join(deg, "src").select("src", F.greatest(F.lit(1), F.ceil(F.col("deg") / piece)).cast("int").alias("n"), "cap"))


def _piece_of(dst: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(dst), n.cast("long")).cast("int")


def _gather(batches):
    t = whole(batches)
    if t is None:
        return
    src, h, dst = (t[c].to_numpy() for c in ("src", "h", "dst"))
    order = np.lexsort((dst, h, src))
    src, h, dst = src[order], h[order], dst[order]
    first = np.flatnonzero(np.r_[True, (src[1:] != src[:-1]) | (h[1:] != h[:-1])])
    n = np.diff(np.r_[first, len(src)])
    for s in portions(n, 1_000_000):
        yield list_batch(["src", "h", "dsts"], [pa.array(src[first[s]]), pa.array(h[first[s]].astype("int32"))], n[s], dst[spread(first[s], n[s])])


def random_walks(edges: DataFrame, num_walks: int = 10, walk_length: int = 40, seed: int = 42, p: float | None = None, q: float | None = None) -> DataFrame:
    """(walk_id, nodes): ``num_walks`` walks from every node with edges, uniform or biased by p and q.

    A step draws a row of the node's neighbours and a place in it, and again where the row is shorter: each neighbour is as likely, and a
    hub's walkers spread over its rows. A biased step keeps a draw with the chance of its weight over the greatest one and draws again
    otherwise, until every walker has moved: that is the same law as weighing all neighbours, and none of them is listed.
    """
    pieces, stat = neighbour_pieces(edges)
    certain = (stat.agg(F.max("n")).first()[0] or 1) == 1
    walks = stat.select(F.col("src").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))).alias("turn"))
    walks = cut(walks.select(F.concat_ws(":", F.col("turn").cast("string"), F.col("at").cast("string")).alias("walk_id"), "at", F.lit(None).cast("long").alias("prev"), F.lit(None).cast("int").alias("prev_n"), F.array("at").alias("nodes")))
    for step in range(1, walk_length):
        bias = None if p is None or step == 1 else (1.0 / p, 1.0 / q)
        walks = walks.join(stat, walks["at"] == stat["src"]).drop("src")
        if not (certain and bias is None):
            walks = cut(walks)
        todo, moves, tried, draws = walks.select("walk_id", "at", "prev", "prev_n", "n", "cap"), None, 0, 1 if bias is None else 2
        while True:
            found = _drawn(todo, pieces, seed, step, tried, draws, bias)
            if certain and bias is None:
                moves = found.select("walk_id", "nxt")
                break
            found = cut(found.groupBy("walk_id").agg(F.min_by("nxt", "t").alias("nxt")))
            moves = found if moves is None else moves.unionByName(found)
            todo = cut(todo.join(found, "walk_id", "left_anti"))
            if todo.isEmpty():
                break
            tried, draws = tried + draws, min(DRAWS, 4 * draws)
        walks = cut(walks.join(moves, "walk_id").select("walk_id", F.col("nxt").alias("at"), F.col("at").alias("prev"), F.col("n").alias("prev_n"), F.concat("nodes", F.array("nxt")).alias("nodes")))
    return walks.select("walk_id", "nodes")


#: Draws of neighbours that a node gets for a step, for each walker that is expected there and eight more.
AHEAD = 2
#: Places of walks in a file.
FILE_PLACES = 400_000


def sharing_walks(graph: Sharing, num_walks: int = 10, walk_length: int = 40, seed: int = 42, ahead: int = AHEAD) -> DataFrame:
    """(walk_id, nodes), a ``written`` table: uniform walks as of ``random_walks``, between nodes that share a key; their pairs are never stored.

    Every node draws neighbours ahead for each step, and walkers that come take its draws in turn: draws are independent of who takes them, so the
    law of the walks is the same. Walkers that find none left wait for the next draws, which follow the visits so far, until all have come to their end.
    A step is a table of its own and reads its own column of draws; walks are put together at the end.
    """
    turns = F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1)))
    nodes = written(graph.nodes(), "zstd")
    todo = nodes.select(turns.alias("turn"), F.col("id").alias("start"), F.lit(0).alias("place"), F.col("id").alias("at"))
    taken, listing, late = [], 0, todo if walk_length > 1 else None
    while late is not None:
        todo, steps = late, walk_length - 1 - late.agg(F.min("place")).first()[0]
        expected = nodes.select("id", F.lit(num_walks).alias("n"))
        if listing:
            waiting = todo.count()
            visits = _places(taken).groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("n"))
            total = visits.agg(F.sum("n")).first()[0]
            expected = visits.select("id", F.ceil(F.col("n") * waiting / total).alias("n"))
        now = todo.groupBy(F.col("at").alias("id")).agg(F.count(F.lit(1)).alias("now"))
        a_step = F.greatest(F.coalesce("now", F.lit(0)), F.when(F.lit(steps > 1), ahead * (F.coalesce("n", F.lit(0)) + 8)).otherwise(0))
        wanted = now.join(expected, "id", "full").select("id", (a_step * steps).alias("want"))
        drawn = graph.draws(wanted.where("want > 0"), seed + 1_000_003 * listing, steps)
        mine = []
        for step in range(steps):
            if todo.isEmpty():
                break
            ranked = todo.withColumn("r", F.row_number().over(Window.partitionBy("at").orderBy("start", "turn")) - 1)
            own = union_all([t.select(F.col("id").alias("at"), f"d{step}") for t in drawn])
            mine.append(written(ranked.join(own, "at", "left").select("turn", "start", "place", "at", F.get(f"d{step}", F.col("r")).alias("nxt")), "zstd"))
            todo = mine[-1].where((F.col("nxt").isNotNull()) & (F.col("place") < walk_length - 2)).select("turn", "start", (F.col("place") + 1).alias("place"), F.col("nxt").alias("at"))
        drop(*drawn)
        taken, listing = taken + mine, listing + 1
        late = _tables(mine).where("nxt IS NULL").select("turn", "start", "place", "at")
        late = None if late.isEmpty() else late
    places = nodes.select(turns.alias("turn"), F.col("id").alias("start"), F.lit(0).alias("place"), F.col("id").alias("node"))
    if taken:
        places = places.unionByName(_places(taken))
    made = places.groupBy("turn", "start").agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("p"))
    found = made.select(F.concat_ws(":", F.col("turn").cast("string"), F.col("start").cast("string")).alias("walk_id"), F.transform("p", lambda x: x["node"]).alias("nodes"))
    found = written(found, "zstd", max(1, FILE_PLACES // walk_length))
    drop(nodes, *taken)
    return found


def _tables(tables: list[DataFrame]) -> DataFrame:
    """All rows of ``written`` tables of one schema, in one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t.written_to for t in tables])


def _places(taken: list[DataFrame]) -> DataFrame:
    return _tables(taken).where("nxt IS NOT NULL").select("turn", "start", (F.col("place") + 1).alias("place"), F.col("nxt").alias("node"))


def _drawn(todo: DataFrame, pieces: DataFrame, seed: int, step: int, tried: int, draws: int, bias: tuple[float, float] | None) -> DataFrame:
    """(walk_id, t, nxt): the draws numbered from ``tried`` that hold."""
    chance = lambda what: uniform(seed, step, F.col("walk_id"), F.col("t"), what, portable=False)
    tries = todo.withColumn("t", F.explode(F.sequence(F.lit(tried), F.lit(tried + draws - 1))))
    tries = tries.withColumn("h", F.floor(chance("row") * F.col("n")).cast("int")).withColumn("j", F.floor(chance("place") * F.col("cap")).cast("int"))
    cand = tries.join(pieces.withColumnRenamed("src", "at"), ["at", "h"]).where(F.col("j") < F.size("dsts")).select("walk_id", "t", "prev", "prev_n", F.get("dsts", F.col("j")).alias("nxt"))
    if bias is None:
        return cand.select("walk_id", "t", "nxt")
    back, away = bias
    near = pieces.select(F.col("src").alias("prev"), "h", F.col("dsts").alias("around"))
    both = cand.withColumn("h", _piece_of(F.col("nxt"), F.col("prev_n"))).join(near, ["prev", "h"], "left")
    weight = F.when(F.col("nxt") == F.col("prev"), back).when(F.array_contains("around", F.col("nxt")), 1.0).otherwise(away)
    return both.where(chance("keep") * max(back, 1.0, away) < weight).select("walk_id", "t", "nxt")


def context_pairs(walks: DataFrame, window: int) -> DataFrame:
    """(walk_id, center, context) of places at most ``window`` apart; no shuffle."""
    places = F.sequence(F.lit(0), F.size("nodes") - 1)
    pairs = F.flatten(F.transform(places, lambda i: F.transform(
        F.filter(F.sequence(F.greatest(i - window, F.lit(0)), F.least(i + window, F.size("nodes") - 1)), lambda j: j != i),
        lambda j: F.struct(F.get("nodes", i).alias("center"), F.get("nodes", j).alias("context")))))
    return walks.where(F.size("nodes") > 0).select("walk_id", F.explode(pairs).alias("p")).select("walk_id", "p.*")


def node_frequency(walks: DataFrame) -> DataFrame:
    return walks.select(F.explode("nodes").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("freq"))


def negative_weights(freq: DataFrame, power: float = 0.75) -> DataFrame:
    """(id, weight): share of freq^power."""
    made = freq.withColumn("__w", F.pow(F.col("freq").cast("double"), F.lit(power)))
    total = made.agg(F.sum("__w")).first()[0] or 1.0
    return made.select("id", (F.col("__w") / F.lit(float(total))).alias("weight"))


def skipgram(walks: DataFrame, dim: int = 128, window: int = 5, epochs: int = 3, negatives: int = 5, lr: float = 0.025, seed: int = 42, shards: int | None = None, table_rows: int = 200_000) -> DataFrame:
    """(id, v), L2-normalised input + output vectors of skip-gram with negative sampling.

    Walks are dealt by their first nodes to shards of about ``SHARD_PAIRS`` pairs, so a task's memory does not grow with the corpus; pairs are made
    in the task and never stored. A shard trains on the vectors of its own nodes, and after each epoch the shards' vectors are averaged by use.
    Negatives come from a table of at most ``table_rows`` draws by frequency^0.75, of which a shard takes those of its own nodes.
    """
    spark = walks.sparkSession
    walks = walks.where(F.size("nodes") > 0)
    if shards is None:
        lengths = walks.agg(F.sum(F.size("nodes").cast("long"))).first()[0] or 0
        shards = max(1, -(-lengths * 2 * window // SHARD_PAIRS))
    dealt = walks.select("walk_id", "nodes", F.lit(0).alias("shard"))
    if shards > 1:
        numbered = number_rows(walks.select("walk_id", F.get("nodes", F.lit(0)).alias("first")), ["first", "walk_id"], "n")
        names = numbered.select("walk_id", F.floor(F.col("n") * shards / walks.count()).cast("int").alias("shard"))
        dealt = walks.join(names, "walk_id").select("walk_id", "nodes", "shard")
    dealt = written(dealt, "zstd", max(1, FILE_PLACES // max(1, walks.agg(F.max(F.size("nodes"))).first()[0] or 1)))
    # A node of walks of its own has no pairs, and no vector.
    paired = dealt.where(F.size("nodes") > 1)
    weights = cut(negative_weights(node_frequency(paired)))
    draw = cut(weights.select("id", (F.col("weight") * table_rows).alias("n")).where((F.floor("n") >= 1) | (uniform(seed, "neg", F.col("id"), portable=False) < F.col("n"))).select("id", F.greatest(F.floor("n"), F.lit(1)).cast("int").alias("n")))
    t = draw.toPandas().sort_values("id")  # at most about table_rows rows
    table = spark.sparkContext.broadcast(np.repeat(t["id"].to_numpy(), t["n"].to_numpy()))
    used = cut(paired.select("shard", F.explode("nodes").alias("id")).distinct())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-used.count() // 50_000))
    j = F.sequence(F.lit(0), F.lit(dim - 1))
    state = weights.select("id", F.transform(j, lambda i: ((uniform(seed, F.col("id"), i, portable=False) - 0.5) / dim).cast("float")).alias("a"), F.transform(j, lambda i: F.lit(0.0).cast("float")).alias("b"))
    for epoch in range(epochs):
        rate = lr * (1 - epoch / epochs)
        held = used.join(state, "id").select("shard", "id", "a", "b")
        trained = held.groupBy("shard").cogroup(paired.groupBy("shard")).applyInArrow(_epoch(table, rate, window, negatives, seed + epoch), "id long, n long, a array<float>, b array<float>")
        state = cut(trained.select("id", "a", "b") if shards == 1 else trained.repartition(tasks, "id").mapInArrow(_averaged, "id long, a array<float>, b array<float>"))
    drop(dealt)
    from ..functions.vectors import l2_normalize

    return state.select("id", l2_normalize(F.zip_with("a", "b", lambda x, y: x.cast("double") + y.cast("double"))).alias("v"))


def _rows(t: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in t[name].chunks] or [np.empty(0, "float32")])


def _vectors(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="int32") * x.shape[1]), pa.array(np.ascontiguousarray(x, "float32").ravel()))


def _averaged(batches):
    """Mean of each node's vectors, weighted by use."""
    t = whole(batches)
    if t is None:
        return
    ids, n = t["id"].to_numpy(), t["n"].to_numpy()
    order = np.lexsort((n, ids))
    first = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]])
    total = np.add.reduceat(n[order], first)[:, None]
    a, b = (np.add.reduceat((_rows(t, c).reshape(len(ids), -1) * n[:, None])[order], first, axis=0) / total for c in ("a", "b"))
    yield pa.RecordBatch.from_arrays([pa.array(ids[order][first]), _vectors(a), _vectors(b)], ["id", "a", "b"])


def _pairs_of_places(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(center, context): places in walks that lie one after the other, of the same walk and at most ``window`` apart."""
    walk = np.repeat(np.arange(len(lengths), dtype="int32"), lengths)
    near = [np.flatnonzero(walk[d:] == walk[:-d]).astype("int32") for d in range(1, window + 1) if d < len(walk)]
    left = np.concatenate(near or [np.empty(0, "int32")])
    right = np.concatenate([x + np.int32(d) for d, x in enumerate(near, 1)] or [np.empty(0, "int32")])
    return np.r_[left, right], np.r_[right, left]


#: Rows of one product: small enough for BLAS to stay in the task's own thread.
STRIP = 32


def _add_products(to: np.ndarray, at: np.ndarray, g: np.ndarray, x: np.ndarray) -> None:
    """Adds g[i, k] * x[i] to row at[i, k], for all of them."""
    rows, place = np.unique(at, return_inverse=True)
    strips = -(-len(rows) // STRIP)
    cell = place.reshape(at.shape) * len(x) + np.arange(len(x))[:, None]
    m = np.bincount(cell.ravel(), g.ravel(), strips * STRIP * len(x)).astype(x.dtype).reshape(strips, STRIP, len(x))
    to[rows] += np.matmul(m, x).reshape(strips * STRIP, -1)[: len(rows)]


#: Most pairs of a batch; fewer nodes than twice that take smaller ones, as a batch adds up the moves of a node that it has many times.
BATCH = 64


def _epoch(table, rate: float, window: int, negatives: int, seed: int):
    def run(held: pa.Table, walks: pa.Table) -> pa.Table:
        if not held.num_rows or not walks.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), **{c: pa.array([], pa.list_(pa.float32())) for c in ("a", "b")}})
        order = np.argsort(held["id"].to_numpy())
        ids = held["id"].to_numpy()[order]
        a, b = (_rows(held, c).reshape(len(ids), -1)[order] for c in ("a", "b"))
        walks = walks.sort_by("walk_id")
        places = np.searchsorted(ids, _rows(walks, "nodes"))
        center, context = _pairs_of_places(np.concatenate([c.value_lengths().to_numpy() for c in walks["nodes"].chunks]), window)
        rnd = np.random.default_rng(seed + walks["shard"][0].as_py())
        pool = np.searchsorted(ids, table.value[np.isin(table.value, ids)])
        pool = pool if len(pool) else np.arange(len(ids))
        order, batch = rnd.permutation(len(center)), max(1, min(BATCH, len(ids) // 2))
        n = np.bincount(places[center], minlength=len(ids)) * 2
        for s in range(0, len(order), batch):
            k = order[s : s + batch]
            x, y = places[center[k]], places[context[k]]
            other = pool[rnd.integers(0, len(pool), (len(x), negatives))]
            target = np.concatenate([y[:, None], other], 1)
            ax, bt = a[x], b[target]
            z = np.einsum("bd,bnd->bn", ax, bt)
            g = -1 / (1 + np.exp(-z))
            g[z > 8], g[z < -8] = -0.9997, -0.0003
            g[:, 0] += 1
            g[:, 1:][other == y[:, None]] = 0
            g = (g * rate).astype("float32")
            da = np.matmul(g[:, None, :], bt)[:, 0]
            _add_products(b, target, g, ax)
            _add_products(a, x[:, None], np.ones((len(x), 1)), da)
        return pa.table({"id": ids, "n": np.maximum(1, n), "a": _vectors(a), "b": _vectors(b)})

    return run


def embed_walks(edges: DataFrame, method: str = "deepwalk", dim: int = 128, walk_length: int = 40, num_walks: int = 10, window: int = 5, epochs: int = 3, negatives: int = 5, lr: float = 0.025, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    if method not in ("deepwalk", "node2vec"):
        raise ValueError(f"unknown method {method!r}")
    biased = method == "node2vec"
    walks = cut(random_walks(edges, num_walks, walk_length, seed, p if biased else None, q if biased else None))
    return skipgram(walks, dim, window, epochs, negatives, lr, seed)
