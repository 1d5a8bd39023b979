"""The corpus pipeline: quality, exact copies, near copies, source mix, tokens.

Each stage reads what its predecessor wrote and calls one operator of ``treeline.llm``. All but the
last return the columns of documents; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from treeline.llm import bpe, exact_dedup, mixing, ngram_jaccard, quality
from treeline.llm.common import remove, shared_folder, table
from treeline.llm.queries import QUALITY_THRESHOLD, quality_trees, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: those with a score of QUALITY_THRESHOLD or more.

    Null and empty texts are scored like others; repeated rows and null ids stay or go by their texts, rows of one text together, so
    ties need no rule. Very long texts are scored whole. An empty table stays empty. Without labels every score is 0.5, so all stay.
    """
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality_trees(docs, table(spark, sf_dir, "labels")), QUALITY_THRESHOLD)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the longest, then the one with the smallest id.

    A null text counts as empty, so of null, empty and blank texts one stays. A null id is the smallest; rows that repeat the one that stays
    in id and normalised text stay with it. Very long texts are compared whole. An empty table stays empty.
    """
    return exact_dedup.keep_first(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle similarity: the one with the smallest id.

    Null and empty texts are linked with nothing and stay, as do texts without words. Rows with a null id stay if no row of their group
    has one; rows that repeat the id that stays stay too. Ties are settled by the id. Very long texts are compared whole. An empty table stays empty.
    """
    return ngram_jaccard.keep_first(docs.select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of their slots in the mix.

    Null sources are a source of their own; null ids, repeated rows, null, empty and very long texts are placed like others. Rows of a block are in the order of
    their ids; an empty table stays empty.
    """
    return mixing.mixed_order(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of ids and decoded text of each document, a row a row.

    Null and empty texts have no tokens; very long texts are encoded whole; repeated rows and null ids stay. An empty table stays empty.
    """
    return bpe.encode_decode(docs, *tokenizer())


STAGES = [("quality", good_quality), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mix", source_mix), ("tokens", tokens)]

#: The classifier, the mix and the merges are not SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over all documents; every stage is written as Parquet and read again, then its input is deleted."""
    docs, top = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        if before:
            remove(spark, f"{top}/{before}")
        docs, before = spark.read.parquet(f"{top}/{name}"), name
    return docs
