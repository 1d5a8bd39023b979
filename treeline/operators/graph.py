"""Relational graph operators: edges (u, v[, w][, pos]), symmetric adjacency (src, dst, w), assignments (id, comm)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, drop, written


def canonical(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges u < v without self-loops."""
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst, w): both directions of every edge row; a self-loop is listed twice. One pass, no shuffle."""
    w = F.col("w") if "w" in edges.columns else F.lit(1)
    both = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    return edges.select(F.explode(both).alias("e"), w.cast("long").alias("w")).select("e.src", "e.dst", "w")


#: Rows of members for each block of nodes, and pairs that a task lists at a time.
BLOCK_MEMBERS, PAIRS_AT_ONCE = 350_000, 1_000_000
#: Most possible pairs that a task marks in a table, and the most for each pair that it lists; beyond, pairs are sorted.
MARKS, MARKS_A_PAIR = 64_000_000, 16


def sharing_pairs(members: DataFrame, key: str, node: str, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """(u, v): distinct pairs u < v of nodes that share a key.

    Nodes are cut into blocks of ids. A key's sorted nodes go to each block that has some of them, as one row, and the block's task lists
    the pairs and drops repeated ones as it goes: pairs are never shuffled, and a task holds lists and distinct pairs only.
    """
    known, blocks, bounds = _blocks(members, key, node, block_members)
    lists = known.repartition(blocks, "key").mapInArrow(_block_lists(bounds), "block int, nodes array<long>")
    return lists.repartition(blocks, "block").mapInArrow(_block_pairs(bounds), "u long, v long")


def _blocks(members: DataFrame, key: str, node: str, block_members: int) -> tuple[DataFrame, int, np.ndarray]:
    """(key, node) without nulls, the number of blocks and the least ids of all blocks but the first."""
    known = members.select(F.col(key).cast("long").alias("key"), F.col(node).cast("long").alias("node")).where("key IS NOT NULL AND node IS NOT NULL")
    blocks = max(1, -(-known.count() // block_members))
    shares = [i / blocks for i in range(1, blocks)]
    return known, blocks, np.unique(np.asarray(known.agg(F.percentile_approx("node", shares)).first()[0] if shares else [], "int64"))


#: Nodes in the lists that go to blocks at a time.
SENT_AT_ONCE = 150_000_000


class Sharing:
    """Nodes that share a key, as neighbours: only each key's nodes are stored, neighbours are listed in the tasks of blocks of nodes, and never written."""

    def __init__(self, members: DataFrame, key: str, node: str, block_members: int = BLOCK_MEMBERS, sent_at_once: int = SENT_AT_ONCE):
        held = written(members.select(key, node), "zstd")  # read three times, and made once
        known, blocks, self.bounds = _blocks(held, key, node, block_members)
        self.sent_at_once = sent_at_once
        # One block of all nodes gives each key's nodes as one row.
        self.lists = written(known.repartition(blocks, "key").mapInArrow(_block_lists(np.empty(0, "int64")), "block int, nodes array<long>").select("nodes"), "zstd")
        drop(held)

    def nodes(self) -> DataFrame:
        """(id) of nodes with neighbours."""
        return self.lists.select(F.explode("nodes").alias("id")).distinct()

    def draws(self, wanted: DataFrame, seed: int, steps: int = 1) -> list[DataFrame]:
        """(id, d0, d1, ...), in ``written`` tables: of each node in ``wanted`` (id, want) so many neighbours, drawn independently and each as likely, in a column for each of ``steps``.

        Keys' lists go to the blocks of wanted nodes, for as many blocks at a time as ``sent_at_once`` allows: more of them take more turns, not more disk.
        """
        wanted = cut(wanted.select("id", F.col("want").cast("long").alias("want")).mapInArrow(_with_block(self.bounds), "block int, id long, want long"))
        blocks = sorted(r["block"] for r in wanted.select("block").distinct().collect())
        sizes = {r["block"]: r["n"] for r in self.lists.mapInArrow(_sent_sizes(self.bounds), "block int, n long").groupBy("block").agg(F.sum("n").alias("n")).collect()}
        file_rows = max(1, PAIRS_AT_ONCE // (2 * max(1, wanted.agg(F.max("want")).first()[0] or 0)))
        out = []
        for turn in portions(np.array([sizes.get(b, 0) for b in blocks]), self.sent_at_once):
            sent = self.lists.mapInArrow(_sent(self.bounds, np.array(blocks[turn])), "block int, nodes array<long>, n array<long>")
            own = wanted.where(F.col("block").between(blocks[turn][0], blocks[turn][-1]))
            drawn = sent.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_drawn_in_block(seed), "id long, drawn array<long>")
            n = F.floor(F.size("drawn") / steps).cast("int")
            out.append(written(drawn.select("id", *[F.slice("drawn", n * k + 1, n).alias(f"d{k}") for k in range(steps)]), "zstd", file_rows))
        return out

    def drop(self) -> None:
        drop(self.lists)


def union_all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _with_block(bounds: np.ndarray):
    def run(batches):
        for b in batches:
            block = np.searchsorted(bounds, b["id"].to_numpy(), side="right").astype("int32")
            yield pa.RecordBatch.from_arrays([pa.array(block), b["id"], b["want"]], ["block", "id", "want"])

    return run


def _visits(b: pa.RecordBatch, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Values of the lists, and for each block that a list has nodes of: the block, the list's start and its length."""
    offsets, values = b["nodes"].offsets.to_numpy(), b["nodes"].values.to_numpy()
    row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
    values = values[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    block = np.searchsorted(bounds, values, side="right")
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])][: len(row)])
    return values, block[first], offsets[row[first]], np.diff(offsets)[row[first]]


def _sent_sizes(bounds: np.ndarray):
    def run(batches):
        n = np.zeros(len(bounds) + 1, "int64")
        for b in batches:
            _, block, _, length = _visits(b, bounds)
            np.add.at(n, block, length)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype="int32")), pa.array(n)], ["block", "n"])

    return run


def _sent(bounds: np.ndarray, blocks: np.ndarray):
    """The lists for some blocks, those of a block packed in one row: their nodes and their lengths."""

    def run(batches):
        for t in gathered(batches, 50_000):
            b = t.combine_chunks().to_batches()[0]
            values, block, first, n = _visits(b, bounds)
            order = np.argsort(block, kind="stable")
            order = order[np.isin(block[order], blocks)]
            block, first, n = block[order], first[order], n[order]
            for s in portions(n, PAIRS_AT_ONCE):
                at = np.flatnonzero(np.r_[True, block[s][1:] != block[s][:-1]])
                ends = np.r_[at, len(block[s])]
                packed = np.r_[0, np.cumsum(n[s])][ends]
                lists = [pa.ListArray.from_arrays(pa.array(o.astype("int32")), pa.array(x)) for o, x in ((packed, values[spread(first[s], n[s])]), (ends, n[s].astype("int64")))]
                yield pa.RecordBatch.from_arrays([pa.array(block[s][at].astype("int32")), *lists], ["block", "nodes", "n"])

    return run


def _flat(t: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in t[name].chunks] or [np.empty(0, "int64")])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chances(seed: int, ids: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Numbers from 0 to below 1 by seed, node and place, however nodes are cut into blocks."""
    step = np.uint64(0x9E3779B97F4A7C15)
    own = _mixed(_mixed(np.full(1, seed, "int64").view("uint64") * step + step) + ids.astype("int64").view("uint64") * step)
    return (_mixed(own + (i.astype("uint64") + np.uint64(1)) * step) >> np.uint64(11)) * 2.0**-53


def _drawn_in_block(seed: int):
    def run(sent: pa.Table, wanted: pa.Table) -> pa.Table:
        if not sent.num_rows or not wanted.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "drawn": pa.array([], pa.list_(pa.int64()))})
        values, n = _flat(sent, "nodes"), _flat(sent, "n")
        order = np.argsort(wanted["id"].to_numpy())
        ids, want = (wanted[c].to_numpy()[order] for c in ("id", "want"))
        names, codes = np.unique(values, return_inverse=True)
        at = np.minimum(np.searchsorted(ids, values), len(ids) - 1)
        own = np.flatnonzero(ids[at] == values)
        own = own[np.argsort(at[own], kind="stable")]
        row = np.repeat(np.arange(len(n)), n)[own]
        who, first, length = at[own], (np.cumsum(n) - n)[row], n[row]
        cuts = np.searchsorted(who, np.arange(len(ids) + 1))
        total, most = np.r_[0, np.cumsum(length)], PAIRS_AT_ONCE
        drawn, counts = [], []
        for s in portions(np.diff(total[cuts]), most):
            lo, found = cuts[s.start], np.empty(0, "int64")
            for p in portions(length[lo : cuts[s.stop]], most):  # several only for a single node of very many
                q = slice(lo + p.start, lo + p.stop)
                found = np.union1d(found, np.repeat(who[q], length[q]) * len(names) + codes[spread(first[q], length[q])])
            w, c = np.divmod(found, len(names))
            other = names[c] != ids[w]
            w, c = w[other], c[other]
            start = np.searchsorted(w, np.arange(s.start, s.stop))
            degree = np.diff(np.r_[start, len(w)])
            k = np.where(degree > 0, want[s], 0)
            place = _chances(seed, np.repeat(ids[s], k), spread(np.zeros(len(k), "int64"), k)) * np.repeat(degree, k)
            drawn.append(names[c[np.repeat(start, k) + place.astype("int64")]])
            counts.append(k)
        offsets = np.r_[0, np.cumsum(np.concatenate(counts))].astype("int32")
        return pa.table({"id": ids, "drawn": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(drawn)))})

    return run


def whole(batches: Iterable[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a task, if any."""
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found) if found else None


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for n numbers each, one after the other."""
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def portions(n: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows of about ``most`` together, of one row at least."""
    total, at = np.cumsum(n), 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield slice(at, end)
        at = end


def list_batch(names: list[str], keys: list[pa.Array], n: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.r_[0, np.cumsum(n)].astype("int32"))
    return pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(offsets, pa.array(values))], names)


def _block_lists(bounds: np.ndarray):
    def run(batches):
        t = whole(batches)
        if t is None:
            return
        key, node = t["key"].to_numpy(), t["node"].to_numpy()
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node = key[new], node[new]
        block = np.searchsorted(bounds, node, side="right")
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        end = np.repeat(ends, ends - starts)
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
        first = first[end[first] - first > 1]
        n = end[first] - first
        for s in portions(n, PAIRS_AT_ONCE):
            yield list_batch(["block", "nodes"], [pa.array(block[first[s]].astype("int32"))], n[s], node[spread(first[s], n[s])])

    return run


def _block_pairs(bounds: np.ndarray):
    def run(batches):
        t = whole(batches)
        if t is None:
            return
        blocks, lists = t["block"].to_numpy(), t["nodes"].combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        for block in np.unique(blocks).tolist():
            rows = np.flatnonzero(blocks == block)
            n = offsets[rows + 1] - offsets[rows]
            names, codes = np.unique(values[spread(offsets[rows], n)], return_inverse=True)
            end = np.repeat(np.cumsum(n), n)
            # Only nodes of this block are the lesser of a pair here.
            own = np.flatnonzero(codes < np.searchsorted(names, bounds[block])) if block < len(bounds) else np.arange(len(codes))
            own = own[np.argsort(codes[own], kind="stable")]
            strip = max(1, MARKS // len(names))
            cuts = np.searchsorted(codes[own], np.arange(0, len(names) + strip, strip))
            for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                if lo == hi:
                    continue
                mine, least = own[lo:hi], k * strip * len(names)
                after = end[mine] - mine - 1
                listed = (np.repeat(codes[mine[s]] * len(names) - least, after[s]) + codes[spread(mine[s] + 1, after[s])] for s in portions(after, PAIRS_AT_ONCE))
                found = _distinct(listed, (int(codes[mine[-1]]) + 1) * len(names) - least, int(after.sum())) + least
                for at in range(0, len(found), 200_000):
                    u, v = np.divmod(found[at : at + 200_000], len(names))
                    yield pa.RecordBatch.from_arrays([pa.array(names[u]), pa.array(names[v])], ["u", "v"])

    return run


def _distinct(listed: Iterable[np.ndarray], below: int, n: int) -> np.ndarray:
    """The distinct ones, in ascending order, of n numbers from 0 to under ``below``: marked in a table where that is small for n, otherwise sorted."""
    if below <= min(MARKS, MARKS_A_PAIR * n):
        marks = np.zeros(below, bool)
        for x in listed:
            marks[x] = True
        return np.flatnonzero(marks)
    found = np.empty(0, "int64")
    for x in listed:
        found = np.union1d(found, x)
    return found


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): adjacency entries; a self-loop counts 2."""
    return symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def weighted_degree(adj: DataFrame) -> DataFrame:
    """(id, degree); every edge is there in both directions, so entries are summed by ``dst``, by which adjacencies are dealt."""
    return adj.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("degree"))


def self_loop_weight(adj: DataFrame) -> DataFrame:
    return adj.where("src = dst").groupBy(F.col("src").alias("id")).agg(F.max("w").alias("w"))


def graph_size(edges: DataFrame) -> DataFrame:
    """One row: nodes (greatest id + 1, ids without edges included) and edge rows."""
    return edges.agg((F.max(F.greatest("u", "v")) + 1).alias("nodes"), F.count(F.lit(1)).alias("edges"))


#: Ids from 0 to the greatest for each id that occurs, beyond which ``all_nodes`` asks for renumbered ids.
SPARSE_IDS = 1_000


def used_nodes(edges: DataFrame) -> DataFrame:
    """(id) of nodes with edges."""
    return edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def all_nodes(edges: DataFrame) -> DataFrame:
    """Every id from 0 to the greatest: ids without edges are nodes too. Ids that are mostly gaps must be renumbered (``renumber``) first."""
    n = graph_size(edges).first()["nodes"] or 0
    few = lambda ids: n > SPARSE_IDS * ids.count()
    if n > SPARSE_IDS and few(edges.select("u").distinct()) and few(used_nodes(edges)):
        raise ValueError(f"ids up to {n - 1} are mostly gaps; renumber them first")
    return edges.sparkSession.range(n)


def number_rows(df: DataFrame, order: list[str], out: str, start: int = 0) -> DataFrame:
    """Gapless numbers by ``order`` without a global window: rows are range-partitioned, numbered in each partition and shifted by the sizes of the partitions before (one row a partition)."""
    dealt = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    local = dealt.withColumn("__local", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    # One row a partition: bounded by the number of shuffle partitions.
    return local.join(F.broadcast(shift), "__p").withColumn(out, F.col("__s") + F.col("__local") - 1 + start).drop("__p", "__s", "__local")


def rank_within(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """0-based places of rows within ``key`` by ``order``; a key's rows may lie in many range partitions, so a hub's are not sorted in one task."""
    placed = number_rows(df, [key, *order], "__at")
    first = placed.groupBy(key).agg(F.min("__at").alias("__first"))
    return placed.join(first, key).withColumn(out, F.col("__at") - F.col("__first")).drop("__at", "__first")


def renumber(edges: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(map (new, old), renumbered edges): ids by first appearance in ``order``, u before v in a row."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("old"), *order, F.lit(0).alias("side")), F.struct(F.col("v").alias("old"), *order, F.lit(1).alias("side")))).alias("e")).select("e.*")
    first = ends.groupBy("old").agg(F.min(F.struct(*order, "side")).alias("f")).select("old", "f.*")
    names = cut(number_rows(first, [*order, "side", "old"], "new").select("new", "old"))
    a, b = names.select(F.col("new").alias("nu"), F.col("old").alias("u")), names.select(F.col("new").alias("nv"), F.col("old").alias("v"))
    return names, edges.join(a, "u").join(b, "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"), *order)


def dense_ids(ids: DataFrame, col: str) -> DataFrame:
    """(old, new): place of each distinct id in ascending order."""
    return number_rows(ids.select(F.col(col).alias("old")).distinct(), ["old"], "new").select("old", "new")


def neighbour_weights(adj: DataFrame, assign: DataFrame) -> DataFrame:
    """(id, comm, w): weight from each node to each community around it, itself left out; its own community is always there."""
    to = adj.where("src <> dst").join(assign.select(F.col("id").alias("dst"), "comm"), "dst").select(F.col("src").alias("id"), "comm", "w")
    own = assign.select("id", "comm", F.lit(0).cast("long").alias("w"))
    return to.unionByName(own).groupBy("id", "comm").agg(F.sum("w").alias("w"))


def quotient(adj: DataFrame, assign: DataFrame) -> DataFrame:
    """(src, dst, w) between communities, the internal directed weight as a self-loop."""
    a, b = assign.select(F.col("id").alias("src"), F.col("comm").alias("cs")), assign.select(F.col("id").alias("dst"), F.col("comm").alias("cd"))
    return adj.join(a, "src").join(b, "dst").groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.sum("w").alias("w"))


def community_totals(adj: DataFrame, assign: DataFrame) -> DataFrame:
    """(comm, tot): summed degree, from the nodes' degrees; edges are not joined."""
    return weighted_degree(adj).join(assign, "id").groupBy("comm").agg(F.sum("degree").alias("tot"))


def inside_weights(adj: DataFrame, assign: DataFrame) -> DataFrame:
    """(comm, inside): directed weight between nodes of one community."""
    a, b = assign.select(F.col("id").alias("src"), "comm"), assign.select(F.col("id").alias("dst"), F.col("comm").alias("cd"))
    return adj.join(b, "dst").join(a, "src").where("comm = cd").groupBy("comm").agg(F.sum("w").alias("inside"))


def modularity(adj: DataFrame, assign: DataFrame) -> DataFrame:
    """One row (modularity) of an assignment."""
    both = community_totals(adj, assign).select("tot", F.lit(0).cast("long").alias("inside")).unionByName(inside_weights(adj, assign).select(F.lit(0).cast("long").alias("tot"), "inside"))
    total = both.agg(F.sum("tot").cast("double").alias("m2"), F.sum("inside").cast("double").alias("i"), F.sum(F.col("tot").cast("double") * F.col("tot").cast("double")).alias("sq"))
    return total.select(F.when(F.col("m2") > 0, (F.col("i") - F.col("sq") / F.col("m2")) / F.col("m2")).alias("modularity"))


def intra_edges(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """Edges inside a community, with it."""
    a, b = assign.select(F.col("id").alias("u"), F.col("comm").alias("cu")), assign.select(F.col("id").alias("v"), F.col("comm").alias("cv"))
    return edges.join(a, "u").join(b, "v").where("cu = cv").drop("cv").withColumnRenamed("cu", "comm")


def local_ids(assign: DataFrame) -> DataFrame:
    """(comm, id, local): place of a node among its community's nodes in ascending order; the members of one community meet in one task, use it on subgraphs that are solved in one."""
    return assign.withColumn("local", F.row_number().over(Window.partitionBy("comm").orderBy("id")) - 1)


def dense_labels(assign: DataFrame) -> DataFrame:
    """Labels renumbered by first appearance, that is by least id."""
    first = assign.groupBy("comm").agg(F.min("id").alias("first"))
    names = number_rows(first, ["first"], "label")
    return assign.join(names.select("comm", "label"), "comm").select("id", F.col("label").alias("comm"))


def compose(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """Assignment of ids through the communities of their communities."""
    return fine.join(coarse.select(F.col("id").alias("comm"), F.col("comm").alias("up")), "comm").select("id", F.col("up").alias("comm"))


def community_sizes(assign: DataFrame) -> DataFrame:
    return assign.groupBy("comm").agg(F.count(F.lit(1)).alias("size"))


def attribute_sums(assign: DataFrame, attrs: DataFrame) -> DataFrame:
    """(comm, size, total array<double>): nodes without attributes count in size only."""
    sizes = community_sizes(assign)
    parts = assign.join(attrs, "id").select("comm", F.posexplode("x").alias("j", "value")).groupBy("comm", "j").agg(F.sum(F.col("value").cast("double")).alias("s"))
    totals = parts.groupBy("comm").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "s"))), lambda x: x["s"]).alias("total"))
    return sizes.join(totals, "comm", "left")


def multi_hot(pairs: DataFrame, key: str, group: str) -> DataFrame:
    """(key, hot): 0/1 vector over the sorted distinct groups (their number is the vector's length)."""
    names = dense_ids(pairs.where(F.col(group).isNotNull()), group)
    width = names.count()
    held = pairs.join(names, pairs[group] == names["old"]).groupBy(key).agg(F.collect_set("new").alias("s"))
    return held.select(key, F.transform(F.sequence(F.lit(0), F.lit(max(0, width - 1))), lambda i: F.array_contains("s", i.cast("long")).cast("int")).alias("hot"))


def feature_hash(feats: DataFrame, key: str, name: str, value: str, width: int) -> DataFrame:
    """(key, hashed array<double>): values summed by a stable hash of their names."""
    from ..functions.rng import hash52

    parts = feats.groupBy(key, (hash52(F.col(name)) % width).alias("j")).agg(F.sum(value).alias("s"))
    maps = parts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("j", "s"))).alias("m"))
    return maps.select(key, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.coalesce(F.col("m")[j.cast("long")], F.lit(0.0))).alias("hashed"))


#: Edges of a task, and of a row, in which components of a part of the edges are found.
PART_EDGES, ROW_EDGES = 500_000, 250_000


def component_parts(edges: DataFrame, part_edges: int = PART_EDGES, in_ranges: bool = False) -> DataFrame:
    """(part, u, v, pos): a ``written`` table of edges as lists, all of one connected component under its least id.

    Each task finds the components of its range of edges; those that share a node are then one. Their number falls from round to round, as
    a range holds few components or edges that lie close together; what is left is done in a task once it is that small. Edges that lie
    ``in_ranges`` of (u, v) already are not shuffled for it.
    """
    dealt = edges.select("u", "v", "pos")
    if not in_ranges:
        dealt = dealt.repartitionByRange(max(1, -(-edges.count() // part_edges)), "u", "v")
    local = written(dealt.mapInArrow(_local_components(2 * part_edges), "root long, u array<long>, v array<long>, pos array<long>"), "zstd")
    ends = local.select("root", F.explode(F.array_union("u", "v")).alias("id")).distinct()
    names = cut(_component_names(_meetings(ends), part_edges))
    whole_parts = written(local.join(names.withColumnRenamed("id", "root"), "root", "left").select(F.coalesce("part", "root").alias("part"), "u", "v", "pos"), "zstd")
    drop(local)
    return whole_parts


def _meetings(ends: DataFrame) -> DataFrame:
    """(u, v): roots that have a node in common, each with the least one there."""
    least = F.min("root").over(Window.partitionBy("id"))
    return cut(ends.select("root", least.alias("least")).where("root <> least").select(F.col("least").alias("u"), F.col("root").alias("v")).distinct())


def _component_names(links: DataFrame, part_edges: int) -> DataFrame:
    """(id, part): the least id of the component of every node that is linked."""
    n = links.count()
    tasks = max(1, -(-n // part_edges))
    dealt = links if tasks > 1 else links.coalesce(1)
    if tasks > 1:
        dealt = links.repartitionByRange(tasks, "u", "v")
    stars = cut(dealt.mapInArrow(_local_names, "id long, root long"))
    if tasks == 1:
        return stars.select("id", F.col("root").alias("part"))
    names = _component_names(_meetings(stars.select("root", "id").distinct()), part_edges)
    best = stars.groupBy("id").agg(F.min("root").alias("root"))
    return best.join(names.withColumnRenamed("id", "root"), "root", "left").select("id", F.coalesce("part", "root").alias("part"))


def least_of_component(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n numbers the least one that it is connected to by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def gathered(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """A task's rows in turn, about ``most`` at a time."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _local_components(most: int):
    def run(batches):
        for t in gathered(batches, most):
            yield from _component_lists(t)

    return run


def _component_lists(t: pa.Table) -> Iterator[pa.RecordBatch]:
    u, v, pos = (t[c].to_numpy() for c in ("u", "v", "pos"))
    ids, codes = np.unique(np.r_[u, v], return_inverse=True)
    root = ids[least_of_component(codes[: len(u)], codes[len(u) :], len(ids))][codes[: len(u)]]
    order = np.lexsort((v, u, root))
    root, u, v, pos = root[order], u[order], v[order], pos[order]
    starts = np.flatnonzero(np.r_[True, root[1:] != root[:-1]])
    lengths = np.diff(np.r_[starts, len(root)])
    rows = -(-lengths // ROW_EDGES)
    first = np.repeat(starts, rows) + spread(np.zeros(len(rows), "int64"), rows) * ROW_EDGES
    n = np.diff(np.r_[first, len(root)])
    for s in portions(n, ROW_EDGES):
        offsets = pa.array(np.r_[0, np.cumsum(n[s])].astype("int32"))
        at = slice(first[s][0], first[s][-1] + n[s][-1])
        yield pa.RecordBatch.from_arrays([pa.array(root[first[s]]), *[pa.ListArray.from_arrays(offsets, pa.array(c[at])) for c in (u, v, pos)]], ["root", "u", "v", "pos"])


def _local_names(batches):
    t = whole(batches)
    if t is None:
        return
    u, v = t["u"].to_numpy(), t["v"].to_numpy()
    ids, codes = np.unique(np.r_[u, v], return_inverse=True)
    root = ids[least_of_component(codes[: len(u)], codes[len(u) :], len(ids))]
    for at in range(0, len(ids), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 200_000]), pa.array(root[at : at + 200_000])], ["id", "root"])
