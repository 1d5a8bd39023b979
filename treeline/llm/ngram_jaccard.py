"""Operator 10: n-gram Jaccard join with count-vector R-trees.

A document is the set of its distinct word shingles, as 64-bit hashes. Hashing shingles into groups
makes a document a point, its count in each group; the summed minima of two points' coordinates
bound the overlap of the sets from above, so pairs whose bound falls short need no verification.

An R-tree over such points alone compares any two documents of like size, because random texts of
like length have like counts: pairs grow with the square of the corpus, however many groups there
are (README has figures for 16 to 1,024 groups). So the token space is first divided by hash value. Every document posts the tokens of a *low* range (a third or so of its
set); a low token held by 2 to ``HOT`` different sets gives candidate pairs, whose number of common
low tokens is the first coordinate, known exactly. A token in more sets than that is *hot* and gives
none. By prefix filtering every link is found that way if one of its documents has enough low
tokens that are not hot (``safe``).

Documents that have not - passages or copies in many documents make up much of them - are joined
with each other by one R-tree over their points. Sets that share a least hash are first compared with
one of them, which joins most members of a family of near copies in work that grows with the family.
The tree is packed in the order of component and size, so that most nodes hold one component. Its
levels are tables; pairs of nodes are expanded level by level unless their boxes, their sizes or a
component that both consist of rule a link out. Of surviving pairs of points those with the best bound
for two components are verified first; once these have merged, all others that are left. Work grows with
the pairs of nodes that survive. All bounds are exact; no link between components is lost, and no cap drops anything.

Documents with equal sets form a class and are handled once. A token's postings are combined in
each task first, so a passage in a third of all documents sends few rows to the task of its tokens.

Words and shingles are compared by 64-bit hashes, not by their characters: two unlike shingles of a
pair pass for one with a chance of about size^2 / 2^64.

Null texts and texts without words have an empty set and are linked with nothing. Repeated rows
have equal sets, and null ids never name a component. A document of any length is one set; a link is
not transitive in itself, its components are, and ties in size or bound decide nothing. An empty table gives an empty
result. Columns beyond id and text, whatever their names, are ignored, or kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, written
from .components import components

SHINGLE = 5
#: Similarity as a fraction, compared in integers.
NUM, DEN = 75, 100
#: Sets that share a token up to which all their pairs are candidates.
HOT = 64
#: Groups into which tokens are hashed, for pairs that share a low token and for points of the R-tree.
GROUPS, POINT = 16, 256
#: Sets in a node of the tree's lowest table and in a leaf inside it, nodes below a node above, sets of a side verified together.
TILE_ROWS, LEAF_ROWS, BRANCH, BLOCK_ROWS = 256, 32, 32, 128
#: Least hashes by which sets meet the first one of their family.
SKETCHES = 4
SLICE = 1_500_000

_WORD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit mixer; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One 64-bit value for each byte at each of the first places of a word.
_PLACES = 64
_BYTE = _mixed(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, joined, and the size of each text's set."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    buf = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    buf = np.where((buf >= 65) & (buf <= 90), buf | 32, buf)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    # A word's hash is a sum of one value for each byte and its place.
    own = np.flatnonzero(~space)
    length = end - start
    place = np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)
    key = (place << 8) | buf[own]
    near = place < _PLACES
    value = _BYTE[np.where(near, key, 0)]
    if not near.all():
        far = ~near
        value[far] = _mixed((key[far] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    total = np.r_[np.uint64(0), np.cumsum(value, dtype=np.uint64)]
    tail = np.cumsum(length)
    word = _mixed(total[tail] - total[tail - length] + length.astype(np.uint64))
    del total, value, key, place
    ends = np.cumsum(sizes)
    words = np.diff(np.r_[0, np.searchsorted(start, ends)])
    first = np.cumsum(words) - words
    count = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    at = np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)
    reach = np.repeat(np.minimum(words, SHINGLE), count)
    hashed = reach.astype(np.uint64)
    for k in range(SHINGLE):
        own = reach > k
        hashed[own] += word[at[own] + k] * _WORD[k]
    hashed = _mixed(hashed)
    bounds = np.r_[0, np.cumsum(count)]
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        hashed[s:e].sort()
    owner = np.repeat(np.arange(len(texts)), count)
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    return hashed[new], np.bincount(owner[new], minlength=len(texts))


def signature(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One 64-bit value for each set; with the set's size it names a class of equal sets."""
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(_mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)), (np.cumsum(n) - n)[some])
    return _mixed(out)


def low_range(n: np.ndarray) -> np.ndarray:
    """Upper end of the low range for sets of n tokens; it falls with n."""
    return np.minimum(1 - 2**-53, 0.30 + 1.6 / np.sqrt(np.maximum(n, 1)))


def prefix(n: np.ndarray) -> np.ndarray:
    """Tokens of a set of n of which any linked set holds one, whatever order tokens are taken in."""
    return n - -(-n * NUM // DEN) + 1


def largest_partner(n: np.ndarray) -> np.ndarray:
    return n * DEN // NUM


def _scaled(x: np.ndarray) -> np.ndarray:
    return (x * 2.0**64).astype(np.uint64)


def slices(b: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch with a bounded amount of text."""
    texts = b.column(text).to_pylist()
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE or i + 1 == len(texts):
            yield b.slice(at, i + 1 - at), texts[at : i + 1]
            at, size = i + 1, 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, sig, n, counts of the tokens above the low range of the set's largest partner, low tokens below that."""
    for b in batches:
        for part, texts in slices(b, 1):
            tokens, n = shingle_sets(texts)
            owner = np.repeat(np.arange(len(n)), n)
            low = tokens < np.repeat(_scaled(low_range(largest_partner(n))), n)
            group = (tokens % np.uint64(GROUPS)).astype(np.int64)
            high = np.bincount(owner[~low] * GROUPS + group[~low], minlength=len(n) * GROUPS)
            counts = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * GROUPS), pa.array(high.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), _signed(signature(tokens, n)), pa.array(n.astype(np.int64)), counts, pa.array(np.bincount(owner[low], minlength=len(n)).astype(np.int64))],
                                             names=["doc_id", "sig", "n", "high", "low"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sig, n) of low tokens, combined within a batch: a token that is hot there alone gives one
    row with n = -1, and each of its sets a row with its signature as key, its number of such tokens
    as sig and -2 - n as n."""
    for b in batches:
        for _, texts in slices(b, 0):
            tokens, n = shingle_sets(texts)
            sig = signature(tokens, n).view(np.int64)
            once = np.zeros(len(n), bool)
            once[np.unique(np.stack([sig, n]), axis=1, return_index=True)[1]] = True
            take = np.repeat(once, n) & (tokens < np.repeat(_scaled(low_range(n)), n))
            owner = np.repeat(np.arange(len(n)), n)[take]
            key = tokens[take].view(np.int64)
            _, inverse, uses = np.unique(key, return_inverse=True, return_counts=True)
            hot = uses[inverse] > HOT
            heads = np.unique(key[hot])
            counts = np.bincount(owner[hot], minlength=len(n))
            held = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([key[~hot], heads, sig[held]])),
                pa.array(np.concatenate([sig[owner[~hot]], np.zeros(len(heads), np.int64), counts[held]])),
                pa.array(np.concatenate([n[owner[~hot]], np.full(len(heads), -1), -2 - n[held]]).astype(np.int32)),
            ], names=["key", "sig", "n"])


_MET = "a long, na int, b long, nb int, c long"


def _met(a, na, b, nb, c) -> pa.RecordBatch:
    none = np.zeros(len(a), bool) if b is not None else np.ones(len(a), bool)
    b = np.zeros(len(a), np.int64) if b is None else b
    nb = np.zeros(len(a), np.int32) if nb is None else nb
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(na.astype(np.int32)), pa.array(b, mask=none), pa.array(nb.astype(np.int32), mask=none), pa.array(c)], names=["a", "na", "b", "nb", "c"])


def alike_in_size(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return np.minimum(na, nb) * DEN >= np.maximum(na, nb) * NUM


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by key: pairs of sets that share a token (c = 1 each), and hot tokens of sets (b null)."""
    rest = np.zeros((3, 0), np.int64)
    hot_key: int | None = None
    for b in _and_end(batches):
        if b is not None:
            rows = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)])
            told = rows[2] <= -2
            if told.any():
                yield _met(rows[0, told], -2 - rows[2, told], None, None, rows[1, told])
            rows = np.concatenate([rest, rows[:, ~told]], axis=1)
            if not rows.shape[1]:
                continue
            whole = int(np.searchsorted(rows[0], rows[0, -1]))
            if whole == 0 and rows.shape[1] < 50_000:
                rest = rows
                continue
            # A run of 50,000 rows is worked on before its end; more than HOT sets in it make its key hot.
            rows, rest = (rows, rows[:, :0]) if whole == 0 else (rows[:, :whole], rows[:, whole:])
        else:
            rows, rest, whole = rest, rest[:, :0], 1
        if not rows.shape[1]:
            continue
        rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
        rows = rows[:, np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(0)]]
        first = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
        size = np.diff(np.r_[first, rows.shape[1]])
        marked = np.add.reduceat(rows[2] == -1, first) > 0
        hot = marked | (size > HOT) | (rows[0, first] == hot_key if hot_key is not None else False)
        if whole == 0 and not hot[0]:
            rest = rows  # repeats of at most HOT sets
            continue
        hot_key = int(rows[0, -1]) if hot[-1] else None
        own = np.repeat(hot, size) & (rows[2] >= 0)
        if own.any():
            yield _met(rows[1, own], rows[2, own], None, None, np.ones(int(own.sum()), np.int64))
        for m in np.unique(size[~hot & (size > 1)]).tolist():
            at = first[~hot & (size == m)]
            i, j = np.triu_indices(m, 1)
            i, j = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            like = alike_in_size(rows[2, i], rows[2, j])
            i, j = i[like], j[like]
            if len(i):
                yield _met(rows[1, i], rows[2, i], rows[1, j], rows[2, j], np.ones(len(i), np.int64))


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, thick, sig, n, tokens) of (doc_id, text, thick); of repeated rows in a batch one."""
    for b in batches:
        for part, texts in slices(b, 1):
            tokens, n = shingle_sets(texts)
            ends = np.cumsum(n)
            blobs = [tokens[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist())]
            sig = signature(tokens, n)
            rows = np.stack([part.column(0).to_numpy(zero_copy_only=False), sig.view(np.int64), n.astype(np.int64)])
            once = np.unique(rows, axis=1, return_index=True)[1]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), _signed(sig), pa.array(n.astype(np.int64)), pa.array(blobs, pa.binary())], names=["doc_id", "thick", "sig", "n", "tokens"]).take(pa.array(once))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def linked(common, na, nb):
    return DEN * common >= NUM * (na + nb - common)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (ra, rb) of linked sets among (ra, rb, ta, tb)."""
    for b in batches:
        keep = []
        for ta, tb in zip(b.column(2), b.column(3)):
            x, y = np.frombuffer(ta.as_buffer(), np.uint64), np.frombuffer(tb.as_buffer(), np.uint64)
            keep.append(linked(overlap(x, y), len(x), len(y)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["ra", "rb"]).filter(pa.array(keep, pa.bool_()))


def points(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts of each set's tokens in ``POINT`` groups, a row a set."""
    owner = np.repeat(np.arange(len(n)), n)
    return np.bincount(owner * POINT + (tokens % np.uint64(POINT)).astype(np.int64), minlength=len(n) * POINT).reshape(len(n), POINT).astype(np.int32)


class Node:
    """Children of a node of the R-tree: boxes (greatest counts, least and greatest size) and the component that a child consists of (-1: several).

    In the lowest table children are sets: points, whose component may be themselves.
    """

    def __init__(self, child, least, most, comp, corner):
        self.child, self.least, self.most, self.comp, self.corner = child, least, most, comp, corner

    @classmethod
    def of(cls, row: dict) -> "Node":
        child, least, most, comp = (np.array(row[c], np.int64) for c in ("child", "least", "most", "comp"))
        return cls(child, least, most, comp, np.frombuffer(row["corner"], np.int32).reshape(len(child), -1))

    def box(self) -> tuple[int, int, int, np.ndarray]:
        """Least and greatest size, component and upper corner of all children."""
        return int(self.least.min()), int(self.most.max()), int(self.comp[0]) if (self.comp == self.comp[0]).all() else -1, self.corner.max(0)

    def part(self, s: slice) -> "Node":
        return Node(self.child[s], self.least[s], self.most[s], self.comp[s], self.corner[s])

    def pairs(self, other: "Node", proper: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices of children that may hold a link between components, and the bound on its overlap; with itself each pair once, pairs of a
        child with itself only if not ``proper``."""
        ok = (self.most[:, None] * DEN >= other.least[None] * NUM) & (other.most[None] * DEN >= self.least[:, None] * NUM)
        ok &= (self.comp[:, None] != other.comp[None]) | (self.comp[:, None] < 0)
        if other is self:
            ok = np.triu(ok, 1 if proper else 0)
        i, j = np.nonzero(ok)
        bound = np.zeros(len(i), np.int64)
        for at in range(0, len(i), 4_096):
            s = slice(at, at + 4_096)
            bound[s] = np.minimum(self.corner[i[s]], other.corner[j[s]]).sum(1)
        keep = (NUM + DEN) * bound >= NUM * (self.least[i] + other.least[j])
        return i[keep], j[keep], bound[keep]

    def leaves(self) -> tuple["Node", list[slice]]:
        """Runs of LEAF_ROWS children as nodes of their own."""
        runs = [slice(at, at + LEAF_ROWS) for at in range(0, len(self.child), LEAF_ROWS)]
        boxes = [self.part(s).box() for s in runs]
        least, most, comp = (np.array(x, np.int64) for x in list(zip(*boxes))[:3])
        return Node(np.arange(len(runs)), least, most, comp, np.stack([x[3] for x in boxes])), runs

    def join(self, other: "Node") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices and bounds of all pairs of points that survive, by way of the leaves."""
        (top, runs), (far, theirs) = self.leaves(), other.leaves()
        far = top if other is self else far
        out = [np.zeros((3, 0), np.int64)]
        for x, y in zip(*top.pairs(far, False)[:2]):
            a = self.part(runs[x])
            b = a if other is self and x == y else other.part(theirs[y])
            i, j, bound = a.pairs(b, True)
            out.append(np.stack([i + runs[x].start, j + theirs[y].start, bound]))
        return tuple(np.concatenate(out, axis=1))


_NODE = "id long, child array<long>, least array<int>, most array<int>, comp array<long>, corner binary"


def _node_row(id_: int, node: Node) -> pa.Table:
    one = lambda x, t: pa.array([x.tolist()], pa.list_(t))
    return pa.table({"id": pa.array([id_], pa.int64()), "child": one(node.child, pa.int64()), "least": one(node.least, pa.int32()), "most": one(node.most, pa.int32()),
                     "comp": one(node.comp, pa.int64()), "corner": pa.array([np.ascontiguousarray(node.corner, np.int32).tobytes()], pa.binary())})


def _boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The box of each node as a child of the level above."""
    for b in batches:
        for row in b.to_pylist():
            least, most, comp, corner = Node.of(row).box()
            yield pa.RecordBatch.from_pylist([{"id": row["id"], "least": least, "most": most, "comp": comp, "corner": corner.tobytes()}], schema=pa.schema(
                [("id", pa.int64()), ("least", pa.int32()), ("most", pa.int32()), ("comp", pa.int64()), ("corner", pa.binary())]))


def _packed(group: pa.Table) -> pa.Table:
    """One node of the children (up, id, least, most, comp, corner), in the order of their ids."""
    group = group.sort_by("at" if "at" in group.column_names else "id")
    corner = np.frombuffer(b"".join(group["corner"].to_pylist()), np.int32).reshape(group.num_rows, -1)
    return _node_row(group["up"][0].as_py(), Node(*(group[c].to_numpy() for c in ("id", "least", "most", "comp")), corner))


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, n, component, corner) of (rep, n, component, tokens)."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            blobs = part.column(3).to_pylist()
            n = np.array([len(x) // 8 for x in blobs], np.int64)
            corner = points(np.frombuffer(b"".join(blobs), np.uint64), n)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([x.tobytes() for x in corner], pa.binary())], names=["rep", "n", "component", "corner"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rep, n): the least hash of each set under each of SKETCHES functions."""
    for b in batches:
        blobs = b.column(2).to_pylist()
        n = np.array([len(x) // 8 for x in blobs], np.int64)
        tokens = np.frombuffer(b"".join(blobs), np.uint64)
        for k in range(SKETCHES):
            least = np.minimum.reduceat(_mixed(tokens ^ _mixed(np.array([k + 1], np.uint64))), np.cumsum(n) - n) if len(n) else tokens
            yield pa.RecordBatch.from_arrays([_signed(_mixed(least + np.uint64(k))), b.column(0), b.column(1)], names=["key", "rep", "n"])


def _family_pairs(dense: DataFrame) -> DataFrame:
    """Pairs (ra, rb) of sets with the first set of those that share a least hash; as many as sets and functions."""
    keys = dense.select("rep", "n", "tokens").mapInArrow(_sketches, "key long, rep long, n long")
    first = keys.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
    met = keys.join(first, "key").select(F.col("rep").alias("ra"), F.col("f.rep").alias("rb"), "n", F.col("f.n").alias("m"))
    like = (F.least("n", "m") * DEN >= F.greatest("n", "m") * NUM) & (F.col("ra") != F.col("rb"))
    return met.where(like).select("ra", "rb").distinct()


def _levels(dense: DataFrame, found: DataFrame) -> list[DataFrame]:
    """Tables of the R-tree over sets (rep, n, tokens) with their components, from the lowest to the root; ids of each run from 0."""
    known = dense.select("rep", "n", "tokens").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n", "component", "tokens")
    placed = known.mapInArrow(_points, "rep long, n long, component long, corner binary")
    order = [F.col("component").asc_nulls_last(), F.col("n"), F.col("rep")]
    sorted_ = written(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    # One row a partition: the rows before it make places gapless.
    part = F.shiftright("at", 33)
    counts = {r["p"]: r["count"] for r in sorted_.groupBy(part.alias("p")).count().collect()}
    before, rows = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(rows)
        rows += counts.get(p, 0)
    place = F.element_at(F.array(*[F.lit(x).cast("long") for x in before or [0]]), part.cast("int") + 1) + F.col("at").bitwiseAND((1 << 33) - 1)
    children = sorted_.select((F.floor(place / F.lit(TILE_ROWS))).alias("up"), place.alias("at"), F.col("rep").alias("id"), F.col("n").cast("int").alias("least"), F.col("n").cast("int").alias("most"),
                              F.coalesce("component", "rep").alias("comp"), "corner")
    levels, nodes = [], -(-rows // TILE_ROWS)
    levels.append(written(children.groupBy("up").applyInArrow(_packed, _NODE)))
    drop(sorted_)
    while nodes > 1:
        boxes = levels[-1].mapInArrow(_boxed, "id long, least int, most int, comp long, corner binary").withColumn("up", F.floor(F.col("id") / F.lit(BRANCH)))
        levels.append(written(boxes.groupBy("up").applyInArrow(_packed, _NODE)))
        nodes = -(-nodes // BRANCH)
    return levels


def _pair_of(group: pa.Table) -> tuple[Node, Node]:
    rows = {r["id"]: Node.of(r) for r in group.to_pylist()}
    return rows[group["a"][0].as_py()], rows[group["b"][0].as_py()]


def _expanded(group: pa.Table) -> pa.Table:
    """Pairs (a, b) of children of a pair of nodes."""
    x, y = _pair_of(group)
    i, j, _ = x.pairs(y, False)
    return pa.table({"a": x.child[i], "b": y.child[j]})


_CANDIDATES = "a long, b long, u int, v int, ra array<long>, rb array<long>, ca array<long>, cb array<long>, rest long"


def _best(group: pa.Table) -> pa.Table:
    return _survivors(group, True)


def _all(group: pa.Table) -> pa.Table:
    return _survivors(group, False)


def _survivors(group: pa.Table, best: bool) -> pa.Table:
    """Pairs of sets of two nodes that survive the bounds: all, or the one with the best bound for two components and the number of others; a row for each two
    blocks u and v of sets."""
    x, y = _pair_of(group)
    i, j, bound = x.join(y)
    rest = np.zeros(len(i), np.int32)
    if best and len(i):
        ca, cb = x.comp[i], y.comp[j]
        order = np.lexsort((-bound, np.maximum(ca, cb), np.minimum(ca, cb)))
        lo, hi = np.minimum(ca, cb)[order], np.maximum(ca, cb)[order]
        first = np.flatnonzero(np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        rest = (np.diff(np.r_[first, len(order)]) - 1).astype(np.int32)
        i, j = i[order[first]], j[order[first]]
    u, v = i // BLOCK_ROWS, j // BLOCK_ROWS
    order = np.lexsort((v, u))
    i, j, u, v, rest = (z[order] for z in (i, j, u, v, rest))
    first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]) if len(i) else np.zeros(0, np.int64)
    lists = lambda z: pa.ListArray.from_arrays(pa.array(np.r_[first, len(i)].astype(np.int32)), pa.array(z.astype(np.int64)))
    whole = lambda c: pa.array(np.full(len(first), group[c][0].as_py(), np.int64))
    return pa.table({"a": whole("a"), "b": whole("b"), "u": pa.array(u[first].astype(np.int32)), "v": pa.array(v[first].astype(np.int32)),
                     "ra": lists(x.child[i]), "rb": lists(y.child[j]), "ca": lists(x.comp[i]), "cb": lists(y.comp[j]),
                     "rest": pa.array(np.add.reduceat(rest, first).astype(np.int64) if len(i) else rest.astype(np.int64))})


def _verified_block(own: pa.Table, pairs: pa.Table) -> pa.Table:
    """Links among candidate pairs of a block, enough to connect what they connect."""
    tokens = {r: np.frombuffer(t, np.uint64) for r, t in zip(own["rep"].to_pylist(), own["tokens"].to_pylist())}
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for ra, rb, ca, cb in zip(*(pairs[c][0].as_py() for c in ("ra", "rb", "ca", "cb"))):
        p, q = find(ca), find(cb)
        if p != q and linked(overlap(tokens[ra], tokens[rb]), len(tokens[ra]), len(tokens[rb])):
            root[p] = q
            out.append((ra, rb))
    return pa.table({"ra": pa.array([x for x, _ in out], pa.int64()), "rb": pa.array([y for _, y in out], pa.int64())})


def _tree_links(dense: DataFrame, found: DataFrame, best: bool) -> tuple[DataFrame, bool]:
    """Links (ra, rb) between different components of ``found`` by a walk down the R-tree over the dense sets: for each two components of two
    nodes the best candidate, or all; and whether these were all."""
    spark, levels = dense.sparkSession, _levels(dense, found)
    pairs, old = spark.createDataFrame([(0, 0)], "a long, b long"), []

    def beside(level):
        ids = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("id"))
        return ids.join(level, "id").groupBy("a", "b")

    for level in reversed(levels[1:]):
        pairs = written(beside(level).applyInArrow(_expanded, "a long, b long"))
        old.append(pairs)
    candidates = written(beside(levels[0]).applyInArrow(_best if best else _all, _CANDIDATES))
    key = ["a", "b", "u", "v"]
    block = [F.col(c).alias(f"k_{c}") for c in key]
    needed = candidates.select(*block, F.explode(F.array_distinct(F.concat("ra", "rb"))).alias("rep")).join(dense.select("rep", "tokens"), "rep")
    links = written(needed.groupBy(*[f"k_{c}" for c in key]).cogroup(candidates.groupBy(*key)).applyInArrow(_verified_block, "ra long, rb long"))
    whole = candidates.where("rest > 0").isEmpty()
    drop(*levels, *old, candidates)
    return links, whole


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, n_shingles, class_id (smallest id with the same set), component_id: one row a row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = cut(texts.mapInArrow(_documents, "doc_id long, sig long, n long, high array<int>, low long"))
    posted = texts.select("text").mapInArrow(_postings, "key long, sig long, n int")
    met = posted.repartition("key").sortWithinPartitions("key").mapInArrow(_meetings, _MET)
    met = written(met.groupBy("a", "na", "b", "nb").agg(F.sum("c").alias("c")))

    hot = met.where("b is null").select(F.col("a").alias("sig"), F.col("na").cast("long").alias("n"), F.col("c").alias("hot"))
    classes = made.where("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.min("high").alias("high"), F.min("low").alias("low"))
    classes = written(classes.join(hot, ["sig", "n"], "left").fillna(0, ["hot"]).where("rep is not null"))

    side = lambda x: classes.select(F.col("sig").alias(x), F.col("n").cast("int").alias(f"n{x}"), F.col("rep").alias(f"r{x}"), F.col("high").alias(f"high_{x}"), F.col("hot").alias(f"hot_{x}"))
    pairs = met.where("b is not null").join(side("a"), ["a", "na"]).join(side("b"), ["b", "nb"])
    summed = F.aggregate(F.zip_with("high_a", "high_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    bound = F.col("c") + F.least("hot_a", "hot_b") + summed
    pairs = written(pairs.where((NUM + DEN) * bound >= NUM * (F.col("na") + F.col("nb"))).select("ra", "rb"))

    need = F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1
    asked = [classes.where(F.col("low") - F.col("hot") < need).select("rep", F.lit(True).alias("thick")), *(pairs.select(F.col(x).alias("rep"), F.lit(False).alias("thick")) for x in ("ra", "rb"))]
    wanted = asked[0].unionByName(asked[1]).unionByName(asked[2]).groupBy("rep").agg(F.bool_or("thick").alias("thick"))
    held = texts.where("doc_id is not null").join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id").select("doc_id", "text", "thick")
    held = held.mapInArrow(_sets, "doc_id long, thick boolean, sig long, n long, tokens binary")
    # Of repeated ids with different texts only the class's own text counts.
    own = classes.select(F.col("rep").alias("doc_id"), "sig", "n")
    sets = written(held.join(own, ["doc_id", "sig", "n"]).select(F.col("doc_id").alias("rep"), "thick", "n", "tokens"))
    thick = sets.where("thick").drop("thick")
    some = not thick.isEmpty()

    of = lambda x: sets.select(F.col("rep").alias(f"r{x}"), F.col("tokens").alias(f"t{x}"))
    verify = lambda p: p.join(of("a"), "ra").join(of("b"), "rb").select("ra", "rb", "ta", "tb").mapInArrow(_verified, "ra long, rb long")
    links = written(verify(pairs.unionByName(_family_pairs(thick)).distinct() if some else pairs))
    found = components(links, "ra", "rb")
    for best in (True, False) if some else ():
        more, whole = _tree_links(thick, found, best)
        if not more.isEmpty():
            before, found = found, components(more.unionByName(found.select(F.col("node").alias("ra"), F.col("component").alias("rb"))), "ra", "rb")
            drop(before)
        drop(more)
        if whole:
            break
    drop(met, pairs, sets, links)

    # Cut off, so that the last join reads nothing but exchanges and a hot class can be split among tasks.
    named = cut(classes.join(found, classes["rep"] == found["node"], "left").where("size > 1 or component is not null").select("sig", "n", "rep", "component"))
    drop(classes, found)
    whole = made.select("doc_id", "sig", "n").join(named, ["sig", "n"], "left")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked documents: the one whose id names the component."""
    ids = jaccard_classes(docs, id_col, text_col).where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(ids, docs[id_col].eqNullSafe(ids[id_col]), "left_semi")
