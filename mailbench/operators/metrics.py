"""Confusion counts, the metrics made of them, and the best model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailbench.functions.decisions import round_n

# Fixed value: digits of latencies.
LATENCY_DIGITS = 3


def confusion(df: DataFrame, by: Sequence[str] = ("model", "ordinal"), pred: str = "pred",
              truth: str = "label") -> DataFrame:
    """n, tp, fp, fn, tn per group; 1 is the positive class.  A row without truth ends the job."""
    said = F.col(pred) == 1
    was = F.coalesce(F.col(truth) == 1, F.raise_error(F.lit(f"a row has no {truth}")).cast("boolean"))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(said & was).alias("tp"),
        F.count_if(said & ~was).alias("fp"),
        F.count_if(~said & was).alias("fn"),
        F.count_if(~said & ~was).alias("tn"),
    )


def accuracy() -> Column:
    """Share of right predictions; null for no rows."""
    return F.try_divide(F.col("tp") + F.col("tn"), F.col("n"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def precision() -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def recall() -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fn"))


def f1() -> Column:
    return _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def model_metrics(counts: DataFrame) -> DataFrame:
    """Confusion counts with the four metrics, each to 4 digits."""
    return counts.select(
        "*",
        round_n(accuracy()).alias("accuracy"),
        round_n(precision()).alias("precision"),
        round_n(recall()).alias("recall"),
        round_n(f1()).alias("f1"),
    )


def best_model_name() -> Column:
    """Aggregate: model with the highest F1, the earliest in the registry on ties."""
    return F.max_by("model", F.struct(F.col("f1"), -F.col("ordinal")))


def best_model(metrics: DataFrame) -> DataFrame:
    return metrics.agg(best_model_name().alias("best_model"))


def with_summary(metrics: DataFrame) -> DataFrame:
    """Metrics rows, each with dataset_size and best_model.

    There is one metrics row per model of the registry, so gathering them is safe.
    """
    return metrics.agg(
        F.collect_list(F.struct(*metrics.columns)).alias("rows"),
        F.max("n").alias("dataset_size"),
        best_model_name().alias("best_model"),
    ).select("dataset_size", "best_model", F.inline("rows"))


def summary_record(metrics: DataFrame) -> DataFrame:
    """One row: dataset_size, map of model to its metrics, best_model."""
    numbers = F.struct("accuracy", "precision", "recall", "f1")
    return metrics.agg(
        F.max("n").alias("dataset_size"),
        F.map_from_entries(F.collect_list(F.struct(F.col("model"), numbers))).alias("metrics"),
        best_model_name().alias("best_model"),
    )


def latency_summary(df: DataFrame, latency: str = "latency_sec") -> DataFrame:
    """Mean latency to 3 digits and row count; a missing latency counts as 0."""
    mean = F.coalesce(F.avg(F.coalesce(F.col(latency), F.lit(0.0))), F.lit(0.0))
    return df.agg(
        round_n(mean, LATENCY_DIGITS).alias("avg_latency_sec"),
        F.count("*").alias("total_processed"),
    )
