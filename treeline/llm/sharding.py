"""Operator 1: sharding by balanced label propagation.

Links join rows with equal texts. Every linked row starts in a shard dealt by its id; in each
round a *cell* (the rows of one group that started together) looks at where its group's other
rows are and asks to move to the fullest shard of its group (of a group that fills several shards:
to one of so many fullest) if it still has room for it. Requests
are granted per target shard in order of gain until the shard's quota is used, so no shard
overflows. Rows without links have no preference and fill the shards up at the end, which makes
row counts equal to within one.

Only cells take part in the iteration: at most ``shards * PIECES`` small rows a group, however
many rows the group has, so a group holding a third of the corpus is neither gathered in one task
nor moved; it ends up in as few shards as the quota allows.

Law: ``rows`` (counts differ by at most one). Nulls: a null text counts 0 bytes, has CRC 0 and is
linked with nothing; empty texts are equal texts. Repeated rows are placed one by one. An empty
table gives an empty result. Columns beyond id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, cut, ranked

#: Cells of a group that start in the same shard; bounds a cell of a huge group.
PIECES = 8
#: Hash slices by which equal gains are granted in part.
SLICES = 64


def shard_rows(docs: DataFrame, shards: int = 24, rounds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, size, text_crc32, law, shard, slot, grown_shard, linked."""
    text = F.col(text_col)
    base = cut(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("h"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(shards * PIECES)).cast("int").alias("cell"),
    ))
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]

    group = ["h", "text_crc32", "size"]
    all_cells = base.where("h is not null").groupBy(*group, "cell").agg(F.count(F.lit(1)).alias("n"))
    linked_groups = all_cells.groupBy(*group).agg(F.sum("n").alias("rows")).where("rows > 1").drop("rows")
    cells = cut(all_cells.join(linked_groups, group).withColumn("shard", (F.col("cell") % shards).cast("int")))
    for turn in range(rounds):
        moved = _round(cells, group, quota, turn)
        if moved is None:
            break
        cells = cut(moved)
    return _placed(base, cells.select(*group, "cell", "shard"), group, quota, total)


def _held(df: DataFrame, n, shards: int) -> list[int]:
    held = [0] * shards
    for r in df.where("shard is not null").groupBy("shard").agg(n.alias("n")).collect():  # one row a shard
        held[r["shard"]] = r["n"]
    return held


def _round(cells: DataFrame, group: list[str], quota: list[int], turn: int) -> DataFrame | None:
    """The cells after one round of granted moves; None when no shard has room or nothing is linked."""
    shards = len(quota)
    held = _held(cells, F.sum("n"), shards)
    room = [max(0, q - h) for q, h in zip(quota, held)]
    if not any(held) or not any(room):
        return None
    rooms = F.array(*[F.lit(r).cast("long") for r in room])
    places = cells.groupBy(*group, "shard").agg(F.sum("n").alias("gn")).groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct("gn", F.xxhash64("h", "shard").alias("tie"), "shard")), asc=False).alias("places"))
    seen = cells.join(places, group).withColumn("own", F.filter("places", lambda p: p["shard"] == F.col("shard"))[0])
    # A group needs as many shards as its rows fill; rows elsewhere spread over the fullest of those that have room.
    rows = F.aggregate("places", F.lit(0).cast("long"), lambda s, p: s + p["gn"])
    home = F.slice("places", F.lit(1), F.ceil(rows / F.lit(max(1, min(quota)))).cast("int"))
    wanted = F.when(F.exists(home, lambda p: p["shard"] == F.col("shard")), F.slice("places", 1, 0)).otherwise(
        F.filter(home, lambda p: F.element_at(rooms, p["shard"] + 1) >= F.col("n")))
    seen = seen.withColumn("wanted", wanted)
    pick = F.pmod(F.xxhash64("h", "cell", F.lit(-turn)), F.greatest(F.size("wanted"), F.lit(1))).cast("int")
    asked = seen.withColumn("goal", F.get("wanted", pick)).select(
        *group, "cell", "n", "shard", F.col("goal.shard").alias("target"),
        F.floor(F.log2(F.col("goal.gn") - F.col("own.gn") + F.lit(1))).cast("int").alias("level"),
        F.pmod(F.xxhash64("h", "cell", F.lit(turn)), F.lit(SLICES)).cast("int").alias("slice"))
    # At most shards * 64 levels * SLICES rows: a bounded table, so it may be broadcast.
    asked_rows = asked.where("target is not null").groupBy("target", "level", "slice").agg(F.sum("n").alias("asked"))
    so_far = Window.partitionBy("target").orderBy(F.desc("level"), "slice")
    granted = asked_rows.withColumn("so_far", F.sum("asked").over(so_far)).where(
        F.col("so_far") <= F.element_at(rooms, F.col("target") + 1)).select("target", "level", "slice", F.lit(True).alias("granted"))
    return asked.join(F.broadcast(granted), ["target", "level", "slice"], "left").select(
        *group, "cell", "n", F.when(F.col("granted"), F.col("target")).otherwise(F.col("shard")).alias("shard"))


def _placed(base: DataFrame, cells: DataFrame, group: list[str], quota: list[int], total: int) -> DataFrame:
    """Linked rows stay up to each shard's quota; all others fill what is left, in hash order."""
    shards, buckets = len(quota), bucket_count(total)
    found = base.join(cells, [*group, "cell"], "left").withColumn("place", F.coalesce("shard", F.lit(-1)))
    bucket = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.lit(buckets)).cast("int")
    row = cut(ranked(found, ["place"], bucket, ["doc_id", "size", "text_crc32"], "rank"))
    kept = [min(h, q) for h, q in zip(_held(row, F.count(F.lit(1)), shards), quota)]
    quotas, keeps = (F.array(*[F.lit(x).cast("long") for x in xs]) for xs in (quota, kept))
    stays = (F.col("place") >= 0) & (F.col("rank") < F.element_at(quotas, F.greatest(F.col("place"), F.lit(0)) + 1))
    over = row.where(~stays)
    pool = ranked(over.drop("rank").withColumn("all", F.lit(0)), ["all"], bucket, ["doc_id", "size", "text_crc32"], "rank").drop("all")
    ends, end = [], 0
    for q, k in zip(quota, kept):
        end += q - k
        ends.append(end)
    ends_col = F.array(*[F.lit(x).cast("long") for x in ends])
    goal = F.size(F.filter(ends_col, lambda e: e <= F.col("rank")))
    start = F.when(goal == 0, F.lit(0).cast("long")).otherwise(F.element_at(ends_col, F.greatest(goal, F.lit(1))))
    filled = pool.select("doc_id", "size", "text_crc32", goal.cast("int").alias("shard"),
                         (F.element_at(keeps, F.least(goal, F.lit(shards - 1)) + 1) + F.col("rank") - start).alias("slot"), (F.col("place") >= 0).alias("linked"))
    stayed = row.where(stays).select("doc_id", "size", "text_crc32", F.col("place").cast("int").alias("shard"), F.col("rank").alias("slot"), F.lit(True).alias("linked"))
    return stayed.unionByName(filled).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "linked")
