"""Operator 2: mixing sources to target weights by Pfair scheduling.

Each source is a task of weight ``a / Q``: exactly its share of the target weights, as whole numbers
of any size. Its block i (a run of ``block_rows`` rows) is released at slot ``floor(i * Q / a)`` and
due by slot ``ceil((i + 1) * Q / a)``; among released blocks the one with the earliest deadline takes
the slot. Weights sum to one, so every block meets its window and after any number of slots each
source that still has rows has had its share of the targets to within one block.

The driver lays the schedule out, a row a block; it skips slots in which nothing is released, so its
time and size grow with the blocks alone, whatever the weights. Row r of a source finds its slot by its
block. Ranks within a source come from bucketed ranks: a source with a third of all rows is spread
over all tasks.

Every row gets a slot: when a source runs dry it leaves the schedule, its later slots stay empty or
take blocks that are released by then, and the others go on in their proportions. Null sources form a
source of their own, apart from the empty string. An empty table gives an empty result. Repeated rows
are scheduled one by one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, md5_bucket, ranked

#: Slots in a period of rounded weights. Raised to four slots a source if there are many.
PERIOD = 1_000
#: Blocks in a schedule that is broadcast; a larger one is joined by a shuffle.
BROADCAST_BLOCKS = 500_000
#: Sources whose weights the driver lays out; more is an error, not a silent change.
MAX_SOURCES = 10_000
BLOCK_ROWS = 64
#: Columns that are made; input columns of these names are left out of ``mix`` and kept by ``mixed_order``.
MADE = ["weight", "block", "release", "deadline", "slot", "place"]
_IN = "__in_"


def source_key(c):
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c))


def quantised(weights: dict[str, float], period: int = PERIOD) -> tuple[dict[str, int], int]:
    """Slots of each source in a period, by largest remainders; a source whose share is below one slot takes one from those with most."""
    if not weights:
        return {}, period
    _bounded(weights)
    period = max(period, 4 * len(weights))
    exact, whole = exact_weights(weights)
    slots = {s: a * period // whole for s, a in exact.items()}
    for s in sorted(exact, key=lambda s: (-(exact[s] * period % whole), s))[: period - sum(slots.values())]:
        slots[s] += 1
    most = [(-n, s) for s, n in slots.items()]
    heapq.heapify(most)
    for s in sorted(s for s, n in slots.items() if n == 0):
        n, rich = heapq.heappop(most)
        slots[s], slots[rich] = 1, -n - 1
        heapq.heappush(most, (n + 1, rich))
    return slots, period


def exact_weights(weights: dict[str, float]) -> tuple[dict[str, int], int]:
    """Whole numbers in the proportions of the weights, without rounding, and their sum."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    unit = lcm(*(p.denominator for p in parts.values()))
    exact = {s: p.numerator * (unit // p.denominator) for s, p in parts.items()}
    return exact, sum(exact.values())


def _bounded(weights: dict) -> None:
    if len(weights) > MAX_SOURCES:
        raise ValueError(f"{len(weights)} sources; at most {MAX_SOURCES} can be weighed")


def schedule(slots: dict[str, int], period: int, blocks: dict[str, int] | None = None) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) by earliest deadline among released blocks: one period, or ``blocks`` of each source."""
    blocks = slots if blocks is None else blocks
    waiting = [(0, s, 0) for s in sorted(slots) if blocks[s] > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    t = 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // slots[s]), s, i))
        _, s, i = heapq.heappop(ready)
        yield s, i, t
        t += 1
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, ((i + 1) * period // slots[s], s, i + 1))


def source_rows(docs: DataFrame, source_col: str = "source") -> dict[str, int]:
    """Rows of each source, counted over all rows."""
    counts = docs.groupBy(source_key(F.col(source_col)).alias("k")).count().limit(MAX_SOURCES + 1).collect()
    return {r["k"]: r["count"] for r in counts}


def natural_weights(rows: dict[str, int], temperature: float = 0.5) -> dict[str, float]:
    """Rows of each source to the power ``temperature``."""
    return {k: float(n) ** temperature for k, n in rows.items()}


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, period: int | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with weight, block, release, deadline, slot and place (row in its block).

    ``weights`` maps sources to positive weights; sources that it leaves out, and all if it is
    None, get the square root of their row count (the scale of given weights is then theirs).
    Weights are exact; with a ``period`` they are rounded to slots of that period.
    """
    names = docs.columns
    made = _mixed(docs, weights, block_rows, period, id_col, source_col)
    return made.select(*[F.col(_IN + c).alias(c) for c in names if c not in MADE], *MADE)


def _mixed(docs, weights, block_rows, period, id_col, source_col) -> DataFrame:
    """Input columns under names of their own, and the columns that are made."""
    spark = docs.sparkSession
    sizes = source_rows(docs, source_col)
    _bounded(sizes)
    targets, total = natural_weights(sizes), sum(sizes.values())
    docs = docs.select(*[F.col(c).alias(_IN + c) for c in docs.columns])
    id_col, source_col = _IN + id_col, _IN + source_col
    for s, w in (weights or {}).items():
        k = "n" if s is None else "s" + s
        if w <= 0:
            raise ValueError(f"the weight of {s!r} must be positive")
        if k in targets:
            targets[k] = float(w)
    slots, whole = exact_weights(targets) if period is None else quantised(targets, period)
    blocks = {k: -(-n // block_rows) for k, n in sizes.items()}
    laid = spark.createDataFrame(_layout(slots, whole, blocks))
    # The schedule is broadcast only up to BROADCAST_BLOCKS rows.
    laid = F.broadcast(laid) if sum(blocks.values()) <= BROADCAST_BLOCKS else laid
    dealt = docs.withColumn("__k", source_key(F.col(source_col)))
    rows = ranked(dealt, ["__k"], md5_bucket(F.col(id_col), bucket_count(total)).cast("int"), [id_col], "__rank")
    rows = rows.withColumn("block", F.floor(F.col("__rank") / F.lit(block_rows)).cast("long"))
    found = rows.join(laid, ["__k", "block"])
    return found.select(
        *[rows[c] for c in docs.columns], "weight", "block", "release", "deadline", "slot",
        (F.col("__rank") % F.lit(block_rows)).alias("place"))


def _layout(slots: dict[str, int], whole: int, blocks: dict[str, int], batch: int = 50_000) -> pa.Table:
    """The schedule as a table, a row a block, built in batches. Windows are whole numbers of any size until they are known."""
    made = [("__k", pa.string()), ("block", pa.int64()), ("weight", pa.float64()), ("release", pa.int64()), ("deadline", pa.int64()), ("slot", pa.int64())]
    names = pa.schema(made)
    parts, rows = [], schedule(slots, whole, blocks)
    while some := list(islice(rows, batch)):
        each = [(s, i, slots[s] / whole, i * whole // slots[s], -(-(i + 1) * whole // slots[s]), t) for s, i, t in some]
        parts.append(pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*each), names)], schema=names))
    return pa.Table.from_batches(parts, names)


def mixed_order(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, period: int | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs``, all rows and columns, range-partitioned and sorted by their slots."""
    order = ["slot", "place", _IN + id_col]
    made = _mixed(docs, weights, block_rows, period, id_col, source_col)
    return made.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(_IN + c).alias(c) for c in docs.columns])
