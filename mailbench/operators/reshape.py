"""Column layouts of the per-e-mail reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailbench.functions.labels import correct, label_to_text
from mailbench.functions.text import PREVIEW_CHARS, prefix
from mailbench.schemas import LLM_OUT, field_names


def flatten_result(df: DataFrame, layout: str = "bulk_v1", key: str = "email_id") -> DataFrame:
    """Metadata columns followed by the fields of ``res``.

    ``bulk_v1``: sender, subject, body preview.  ``bulk_v2``: sender, subject, and the
    latency at the end.  ``benchmark``: body preview, actual, predicted, correct, and the
    latency if there is one.
    """
    fields = [F.col("res")[name].alias(name) for name in field_names(LLM_OUT)]
    preview = prefix(F.coalesce("body", F.lit("")), PREVIEW_CHARS).alias("body")
    if layout == "bulk_v1":
        meta = [F.col("sender"), F.col("subject"), preview]
    elif layout == "bulk_v2":
        meta = [F.col("sender"), F.col("subject")]
    elif layout == "benchmark":
        predicted = F.coalesce(F.col("res")["is_spam"].cast("int"), F.lit(0))
        meta = [
            preview,
            F.col("label").alias("actual"),
            predicted.alias("predicted"),
            correct(predicted, F.col("label")).alias("correct"),
        ]
    else:
        raise ValueError(f"unknown layout: {layout}")
    tail = [F.col("latency_sec")] if layout != "bulk_v1" and "latency_sec" in df.columns else []
    return df.select(key, *meta, *fields, *tail)


def rename_llm_columns(df: DataFrame, text: str = "text", label: str = "label", ml: str = "ml",
                       key: str = "email_id") -> DataFrame:
    """The comparison of a classifier and a language model, ten columns after the key."""
    truth = label_to_text(F.col(label))
    said = label_to_text(F.col("res")["is_spam"])
    return df.select(
        key,
        F.col(text).alias("text"),
        truth.alias("true_label"),
        F.col(ml)["label"].alias("ml_prediction"),
        correct(F.col(ml)["label"], truth).alias("ml_correct"),
        said.alias("llm_prediction"),
        correct(said, truth).alias("llm_correct"),
        F.col("res")["category"].alias("llm_category"),
        F.col("res")["intent"].alias("llm_intent"),
        F.col("res")["confidence"].alias("llm_confidence"),
        F.col("res")["reason"].alias("llm_reason"),
    )
