"""One query per operator over whole tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailbench.llm import (
    ann, conversation_repair, license_scan, packing, paragraph_dedup, personal_data, quality_rules, resampling,
    sentencepieces, simhash, token_counts, warc, wavelet,
)
from mailbench.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_license_scan(spark, sf_dir):
    return license_scan.license_scan(
        table(spark, sf_dir, "documents"), "doc_id", "text", license_scan.known_licenses(spark))


ORACLE["op1_license_scan"] = license_scan.license_scan_sql()


@query
def op2_quality_rules(spark, sf_dir):
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


@query
def op3_multi_index_hashing(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)


@query
def op4_warc_segments(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


@query
def op5_wavelet_shards(spark, sf_dir):
    manifest = wavelet.write_token_shards(table(spark, sf_dir, "documents"), "doc_id", "text", BYTE_BPE, end_id=2)
    return wavelet.read_token_shards(manifest)


@query
def op6_paragraph_dedup(spark, sf_dir):
    return paragraph_dedup.repeated_passages(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op7_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", BYTE_BPE)


@query
def op8_pattern_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", BYTE_BPE)


@query
def op9_piece_codec(spark, sf_dir):
    return sentencepieces.piece_codec(table(spark, sf_dir, "documents"), "doc_id", "text", PIECES, full=False)


@query
def op10_simhash(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op11_importance_resampling(spark, sf_dir):
    return resampling.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op11_importance_resampling"] = resampling.importance_resample_sql()


@query
def op12_personal_data(spark, sf_dir):
    return personal_data.personal_data(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op13_conversation_repair(spark, sf_dir):
    return conversation_repair.repair_conversations(table(spark, sf_dir, "conversations"), damage=True)
