"""A training corpus from documents: quality rules, line dedup, near-duplicates, decontamination, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import decontaminate, line_dedup, near_dup, packing, quality
from driftline.llm.common import BROADCAST_KEYS, Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids (distinct); ids are broadcast only if they are few."""
    if ids.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_anti").select(COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # a condition on a row number stays above the projection; pushed below, it would work out the rules once for each use
    judged = quality.quality_rules(docs, labels).withColumn("row", F.monotonically_increasing_id())
    return judged.where("kept and row >= 0").select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; a document that loses all its lines goes."""
    out = line_dedup.line_dedup(docs)
    out = out.where("n_removed = 0 or n_removed < n_lines")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id."""
    gone = near_dup.near_duplicates(docs).where("not kept").select("doc_id")
    return _without(docs, Scratch(spark, "near-stage").put(gone, "gone"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item has leaked into."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, Scratch(spark, "benchmark-stage").put(found.select("doc_id").distinct(), "gone"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Tokenizers are outside SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
