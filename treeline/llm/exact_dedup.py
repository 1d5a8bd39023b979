"""Operator 6: exact deduplication by content-defined chunk recipes.

A text without white space is cut into chunks where its content says so, so equal texts are cut
alike wherever they lie. Each distinct chunk is moved once, to check that its 64-bit fingerprint
stands for that content alone; a fingerprint that several contents share is replaced by verified
identifiers (fingerprint and rank of the content). A document's *recipe* is the ordered list of its
chunks' identifiers, eight bytes a chunk; rows are grouped by comparing whole recipes. Documents
themselves are never shuffled.

A group is pre-aggregated in each task, and its row count and survivor come back through a join
that adaptive execution splits when a group is hot. Null texts count as empty; all empty texts are
equal. Ties go to the smallest id; repeated rows count one by one. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, cut

#: A chunk has 512 to 4096 characters and ends behind one of these pairs, or is cut at the maximum.
LEAST, MOST = 512, 4096
ENDS = r"(?<=a[bdg]|e[cmp]|i[bkt]|o[gpt]|u[hmc]|\.[b-t]|[0-9]7)"
CHUNKS = f"(?s).{{{LEAST},{MOST - 1}}}?{ENDS}|.{{{LEAST},{MOST}}}|.+"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACES}]+", "")


def _chunks(docs: DataFrame, text_col: str, pattern: str) -> DataFrame:
    return docs.withColumn("__norm", normalised(F.col(text_col))).withColumn("__chunks", F.regexp_extract_all("__norm", F.lit(pattern), F.lit(0)))


def fingerprint(c):
    return F.xxhash64(c)


def verified_collisions(docs: DataFrame, text_col: str, pattern: str, mark) -> DataFrame:
    """Fingerprints that stand for more than one chunk content; usually none."""
    chunks = _chunks(docs.select(text_col), text_col, pattern).select(F.explode(F.array_distinct("__chunks")).alias("chunk"))
    distinct = chunks.distinct().select(mark(F.col("chunk")).alias("fp"))
    shared = distinct.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return shared.select("fp")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = CHUNKS, mark=fingerprint) -> DataFrame:
    """Columns doc_id, keep_id, group_size, kept, text_sha256: one row a row of ``docs``.

    ``mark`` gives a chunk's fingerprint; tests pass a weak one to force collisions.
    """
    whole = F.coalesce(F.col(text_col), F.lit(""))
    cut_up = _chunks(docs.select(F.col(id_col), F.col(text_col)), text_col, pattern)
    recipes = cut(cut_up.select(
        F.col(id_col).alias("doc_id"), F.char_length(whole).cast("long").alias("points"), F.sha2("__norm", 256).alias("text_sha256"),
        F.transform("__chunks", mark).alias("recipe")))
    clashes = cut(verified_collisions(docs, text_col, pattern, mark))
    if not clashes.isEmpty():
        recipes = cut(_with_verified(docs, id_col, text_col, pattern, mark, clashes))
    # The whole recipe is the key; its hash leads, so that rows with different recipes rarely compare.
    key = ["mark", "recipe"]
    marked = recipes.withColumn("mark", F.xxhash64("recipe"))
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id"))).alias("best")
    groups = marked.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), best)
    # A group of one is its own survivor: only larger groups are joined back. They are cut off first, so that
    # the join reads nothing but exchanges and a hot group's rows can be split among tasks.
    shared = cut(groups.where("group_size > 1").select(*key, "group_size", F.col("best.doc_id").alias("keep_id")))
    found = marked.join(shared, key, "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def _with_verified(docs, id_col, text_col, pattern, mark, clashes):
    """Recipes in which chunks of clashing fingerprints carry identifiers checked by content."""
    spot = F.posexplode("__chunks").alias("pos", "chunk")
    parts = _chunks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col), F.monotonically_increasing_id().alias("row")), text_col, pattern)
    parts = parts.select("doc_id", "row", F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("points"), F.sha2("__norm", 256).alias("text_sha256"), F.col("__chunks"))
    held = parts.select("row", "doc_id", "points", "text_sha256", F.posexplode_outer("__chunks").alias("pos", "chunk"))
    held = held.withColumn("fp", mark(F.col("chunk")))
    names = held.join(clashes, "fp", "left_semi").select("fp", "chunk").distinct()
    names = names.select("fp", "chunk", F.row_number().over(Window.partitionBy("fp").orderBy("chunk")).alias("rank"))
    known = held.join(names, ["fp", "chunk"], "left")
    ident = F.when(F.col("pos").isNotNull(), F.struct("pos", F.concat(F.lpad(F.hex("fp"), 16, "0"), F.lpad(F.hex(F.coalesce("rank", F.lit(0)).cast("long")), 8, "0")).alias("name")))
    listed = known.groupBy("row", "doc_id", "points", "text_sha256").agg(F.sort_array(F.collect_list(ident)).alias("ids"))
    return listed.select("doc_id", "points", "text_sha256", F.transform("ids", lambda x: x["name"]).alias("recipe"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``dedup`` marks as kept, null ids too; of repeated rows with a surviving id all stay apart from copies that lost."""
    kept = dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha256")).distinct()
    same = docs[id_col].eqNullSafe(kept["__id"]) & (F.sha2(normalised(docs[text_col]), 256) == kept["__sha256"])
    return docs.join(kept, same, "left_semi")
