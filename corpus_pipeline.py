"""A corpus from raw documents: filter, deduplicate, decontaminate, mix.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is
written as Parquet and read again as the next one's ``docs``.  The last stage returns the manifest
of the mix: one row per document that it takes, with how often.

Defined cases: null and empty texts fail the quality rules; decisions hold for rows, not ids, so null
and shared ids are judged by their texts; equal rows are near-duplicates, of which one stays; very long
texts are read whole; further columns are carried to the last stage; empty tables give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecraft.llm import decontam, jaccard, linededup, mixing, quality
from linecraft.llm.common import free, fresh, scratch, stored, table, without

#: Near-duplicates of the pipeline: five words a shingle, 80 % of the union.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are mostly boilerplate go."""
    return quality.keep_good(docs, quality.learn_field(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; so does what is left of a document of which they were 80 % or more."""
    return linededup.without_repeated_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays (null ids come last).

    Rows are told apart by a number of their own, so rows without an id are deduplicated too and rows
    that share an id are judged by their texts.
    """
    row = fresh("row", docs.columns)
    held = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    found = jaccard.jaccard_components(held.select(F.col(row).alias("doc_id"), "text"), SHINGLE, PERCENT)
    found = stored(found.filter("n_shingles > 0").select(F.col("doc_id").alias("r"), F.col("component_id").alias("c")))
    groups = found.groupBy("c").count().filter("count > 1").select("c")
    members = found.join(groups, "c").join(held.select(F.col(row).alias("r"), "doc_id"), "r")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r")
    keep = members.groupBy("c").agg(F.min(rank)["r"].alias("keep"))
    gone = members.join(keep, "c").filter("r != keep").select("r")
    return without(held, gone, row).drop(row)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how often."""
    return mixing.balanced_mix(docs).filter(F.col("times") > 0).select("doc_id", "source", "size", "target", "times", "taken")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
]

#: SQL cannot express the sequence labelling and the balanced sampling; tests hold the stages against
#: plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = None
    for _, stage in STAGES:
        before = docs
        with scratch() as keep:  # what a stage stores on its way goes when its result is written
            docs = keep(stored(stage(spark, table(spark, sf_dir, "documents") if before is None else before, sf_dir)))
        if before is not None:
            free(before)
    return docs
