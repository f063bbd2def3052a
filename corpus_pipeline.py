"""The corpus pipeline: quality rules, near-duplicates, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailbench.llm.common import free_names, with_own_key
from mailbench.llm.packing import pack_documents
from mailbench.llm.paragraph_dedup import without_repeats
from mailbench.llm.quality_rules import quality_verdicts
from mailbench.llm.simhash import simhash_components
from mailbench.session import scratch_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _kept(docs: DataFrame, chosen) -> DataFrame:
    """The rows whose own key ``chosen(rows, own)`` gives; rows with null or repeated keys are judged each for themselves."""
    own, kept = free_names(docs, "_own", "_kept")
    rows = with_own_key(docs, "doc_id", own)
    keys = chosen(rows, own).select(F.col(own).alias(kept))
    return rows.join(keys, F.col(own) == F.col(kept), "left_semi").select(*[F.col(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return _kept(docs, lambda rows, own: quality_verdicts(rows, own).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest key; null and repeated keys come last."""
    return _kept(docs, lambda rows, own: simhash_components(rows, own, "text").where("doc_id = component_id")
                 .withColumnRenamed("doc_id", own))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document or place has."""
    (own,) = free_names(docs, "_own")
    cut = without_repeats(with_own_key(docs, "doc_id", own), own, "text")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens."""
    return pack_documents(docs, "doc_id", "text", BYTE_BPE)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("packing", packed)]

# Iterated estimates, hashes of shingles and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
