"""Operator 5: quality classifier, histogram gradient-boosted trees over document statistics.

Statistics of each whole text are computed in Arrow batches. Trees are grown on the driver from a
bounded sample of labelled rows (``TRAIN_ROWS``), feature values binned by their quantiles; they
are flattened into arrays of features, thresholds and leaf values, which every task walks with
numpy, all rows at once, one step a level.

Null texts count as empty; empty texts are scored too. Rows with a null label teach nothing;
repeated or contradictory labels count one by one. Without any label every score is 0.5. Repeated
rows are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import md5_bucket

#: Labelled rows to learn from, at most about so many.
TRAIN_ROWS = 20_000
#: Size of the trees.
TREES, DEPTH, BINS, RATE, L2, LEAST_ROWS = 60, 4, 64, 0.2, 1.0, 20
FEATURES = ["log_bytes", "log_words", "upper", "digits", "exclaim", "symbols", "pipes", "stops", "spaces", "lines", "wide", "word_bytes", "line_bytes", "distinct_words", "distinct_lines"]

#: Classes of bytes, each a feature: its share of the text.
_CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?", "#$%&*+<=>@^_`~{}\\/[]", "|", ".,;:", " \t", "\n"]
_BYTE_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _BYTE_CLASS[list(_chars.encode())] = _i + 1
_BYTE_CLASS[128:] = len(_CLASSES) + 1


def statistics(texts: list[str | None]) -> np.ndarray:
    """FEATURES of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((len(raw), len(FEATURES)))
    size = np.array([len(r) for r in raw], np.int64)
    some = np.flatnonzero(size)
    if len(some):
        kind = _BYTE_CLASS[np.frombuffer(b"".join(raw), np.uint8)]
        starts = (np.cumsum(size) - size)[some]
        for k in range(1, len(_CLASSES) + 2):
            out[some, k + 1] = np.add.reduceat(kind == k, starts, dtype=np.int64) / size[some]
    for i, t in enumerate(texts):
        words, lines = (t or "").split(), (t or "").split("\n")
        n = max(1, len(words))
        distinct = set(words)
        out[i, 1] = np.log1p(len(words))
        out[i, 11:15] = size[i] / n, size[i] / len(lines), len(distinct) / n, len(set(lines)) / len(lines)
    out[:, 0] = np.log1p(size)
    return out


@dataclass
class Trees:
    """Complete binary trees in arrays; a node's children are 2i + 1 and 2i + 2, the last level holds values."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for log loss; splits are chosen from gradient histograms over quantile bins."""
    nodes, leaves = 2**DEPTH - 1, 2**DEPTH
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        raw = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            feature, threshold = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
            at = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                cut = np.zeros(width, np.int64)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = (at - first) * BINS + binned[:, f]
                    sums = [np.bincount(key, w, width * BINS).reshape(width, BINS) for w in (g, h, np.ones(len(y)))]
                    (gl, hl, nl), (ga, ha, na) = ([np.cumsum(s, 1) for s in sums], [s.sum(1, keepdims=True) for s in sums])
                    gain = gl**2 / (hl + L2) + (ga - gl) ** 2 / (ha - hl + L2) - ga**2 / (ha + L2)
                    gain[(nl < LEAST_ROWS) | (na - nl < LEAST_ROWS)] = 0
                    gain[:, len(e) :] = 0
                    where = gain.argmax(1)
                    better = gain[np.arange(width), where] > best
                    best = np.where(better, gain[np.arange(width), where], best)
                    feature[first : first + width][better] = f
                    threshold[first : first + width][better] = e[where[better]]
                    cut[better] = where[better]
                went = x[np.arange(len(y)), feature[at]] > threshold[at]
                at = 2 * at + 1 + went
            leaf = at - nodes
            value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
            trees.append((feature, threshold, value))
            raw += value[leaf]
    shape = lambda i, n, kind: np.array([t[i] for t in trees], kind).reshape(len(trees), n)
    return Trees(base if len(y) else 0.0, shape(0, nodes, np.int64), shape(1, nodes, float), shape(2, leaves, float))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Trees from at most about ``rows`` labelled rows, drawn by a hash of their id."""
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y"))
    total = known.count()
    space = 1 << 32
    drawn = known.where(md5_bucket(F.col("__id"), space) < min(space, rows * space // max(1, total)))
    # The sample is bounded by ``rows``, so it may be broadcast: texts stay where they are.
    drawn = drawn.limit(2 * rows)
    held = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(drawn), "__id")
    names = ", ".join(f"f{i} double" for i in range(len(FEATURES)))
    got = held.select("__id", "__y", "__text").mapInArrow(_statistics_of, f"y double, id string, {names}").toArrow()
    got = got.sort_by([("id", "ascending"), ("y", "ascending"), ("f0", "ascending")])
    x = np.stack([got[f"f{i}"].to_numpy() for i in range(len(FEATURES))], axis=1) if got.num_rows else np.zeros((0, len(FEATURES)))
    return grow(x, got["y"].to_numpy())


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1_000):
            part = b.slice(at, 1_000)
            x = statistics(part.column(2).to_pylist())
            ids = pa.array([str(i) for i in part.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(1), ids, *[pa.array(x[:, i]) for i in range(x.shape[1])]], names=["y", "id", *[f"f{i}" for i in range(x.shape[1])]])


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and score (0 to 1, higher: label 1 likelier) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                found = model.value.score(statistics(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=[b.schema.names[0], "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep_good(docs: DataFrame, trees: Trees, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns, in one pass."""
    model = docs.sparkSession.sparkContext.broadcast(trees)
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                found = model.value.score(statistics(part.column(at_text).to_pylist()))
                yield part.filter(pa.array(found >= threshold))

    return docs.mapInArrow(run, docs.schema)
