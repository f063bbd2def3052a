"""Reports on classifiers: benchmark, details, archive benchmark, predictions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailbench.functions.labels import correct, label_to_text, text_to_label
from mailbench.functions.text import compose_for, heuristic_label, min_length_filter
from mailbench.operators.ensemble import (
    ensemble_vote,
    models_map,
    labels_of,
)
from mailbench.operators.limits import limit_rows, sample_rows
from mailbench.operators.metrics import confusion, model_metrics, summary_record
from mailbench.operators.scorers import Scorer, score_all
from mailbench.session import stage
from mailbench.sources.files import list_mail_paths
from mailbench.sources.mail import read_mail

# Fixed value: files that the described service samples from an archive; pass it as ``sample``.
ARCHIVE_SAMPLE = 200
ARCHIVE_NOTE = "labels come from keywords, so the metrics are approximate"


class Benchmark(NamedTuple):
    """Metrics per model, a one-row summary, and the per-e-mail rows if asked for."""

    metrics: DataFrame
    summary: DataFrame
    details: DataFrame | None


def _names(scorers: Sequence[Scorer]) -> list[str]:
    return [s.name for s in scorers]


def score_composed(df: DataFrame, scorers: Sequence[Scorer], key: str = "email_id",
                   null_as: str = "", labels: DataFrame | None = None) -> DataFrame:
    """Key, composed text, label and one prediction per scorer.

    With ``labels``, a table of key and label, texts are scored where they are read and meet
    their label after; columns that nothing uses are not shuffled.
    """
    text = compose_for(df, null_as).alias("text")
    if labels is None:
        return score_all(df.select(key, text, "label"), scorers)
    return score_all(df.select(key, text), scorers).join(labels.select(key, "label"), key)


def _labelled(df: DataFrame, labels: DataFrame | None, key: str, only: bool) -> DataFrame:
    """Texts that have a label, found by keys alone: for models dearer than a join."""
    return df if labels is None or not only else df.join(labels.select(key), key, "left_semi")


def _said(scored: DataFrame, names: Sequence[str], *keep: str) -> DataFrame:
    """``keep`` and each model's 0/1 answer."""
    return scored.select(*keep, *[text_to_label(F.col(name)["label"]).alias(name) for name in names])


def _metrics(said: DataFrame, names: Sequence[str]) -> DataFrame:
    long = said.select("label", F.inline(F.array(*[
        F.struct(F.lit(name).alias("model"), F.lit(place).alias("ordinal"), F.col(name).alias("pred"))
        for place, name in enumerate(names)
    ])))
    return model_metrics(confusion(long))


def metrics_of(scored: DataFrame, scorers: Sequence[Scorer]) -> DataFrame:
    """One metrics row per scorer: a single aggregation with one group per model.

    Answers are taken out before rows are multiplied, so nothing else is computed.
    """
    return _metrics(_said(scored, _names(scorers), "label"), _names(scorers))


def metrics_of_label_table(texts: DataFrame, labels: DataFrame, scorers: Sequence[Scorer],
                           key: str = "email_id", composed: bool = True) -> DataFrame:
    """Metrics where ``labels`` (key, label) is a table of its own.

    Texts, composed or raw, are scored where they are read; what meets the labels is a
    row of a few numbers, so no text is shuffled however large both tables are.
    """
    text = compose_for(texts) if composed else F.coalesce("text", F.lit(""))
    scored = score_all(texts.select(key, text.alias("text")), scorers)
    said = _said(scored, _names(scorers), key)
    return _metrics(said.join(labels.select(key, "label"), key), _names(scorers))


def details_of(scored: DataFrame, scorers: Sequence[Scorer], key: str = "email_id") -> DataFrame:
    """Per e-mail: text, true label, majority vote, whether it is right, map of all models."""
    truth = label_to_text(F.col("label"))
    vote = ensemble_vote(labels_of(_names(scorers)))
    return scored.select(
        key,
        "text",
        truth.alias("true_label"),
        vote.alias("ensemble_prediction"),
        correct(vote, truth).alias("ensemble_correct"),
        models_map(_names(scorers), truth).alias("models"),
    )


def detailed_results(df: DataFrame, scorers: Sequence[Scorer], key: str = "email_id",
                     labels: DataFrame | None = None, only_labelled: bool = False) -> DataFrame:
    """:func:`details_of` the composed texts; labels in ``df``, or in a table of their own."""
    return details_of(score_composed(_labelled(df, labels, key, only_labelled), scorers, key, labels=labels), scorers, key)


def benchmark(df: DataFrame, scorers: Sequence[Scorer], limit: int | None = None,
              detailed: bool = False, key: str = "email_id",
              summary_models: Sequence[str] | None = None, null_as: str = "",
              labels: DataFrame | None = None, only_labelled: bool = False) -> Benchmark:
    """Score the composed texts and compare with the labels.

    ``summary_models`` restricts the metrics; details cover every scorer.  The input is
    read and each text scored once per model, here: scores that details will need are
    staged first, and the few metrics rows are stored for all that refers to them.
    ``labels`` may be a table of its own; ``only_labelled`` then keeps unlabelled texts from
    being scored, at the price of shuffling texts by key if the labels are too many to broadcast.
    A ``limit`` counts labelled texts.
    """
    measured = [s for s in scorers if summary_models is None or s.name in summary_models]
    used = scorers if detailed else measured
    chosen = limit_rows(_labelled(df, labels, key, only_labelled or bool(limit)), limit, key)
    scored = score_composed(chosen, used, key, null_as, labels)
    if detailed:
        scored = stage(scored, "scored")
    metrics = stage(metrics_of(scored, measured), "metrics")
    details = details_of(scored, scorers, key) if detailed else None
    return Benchmark(metrics, summary_record(metrics), details)


def archive_dataset(spark: SparkSession, root: str | DataFrame, sample: int | None = None,
                    seed: int | str = 0) -> DataFrame:
    """``path, from, subject, text, label`` of the mail files below ``root``, or of ``sample`` of them.

    ``root`` may also be a table with a column ``path``, such as a bucket inventory; then nothing
    is listed.  Paths are sampled before any file is opened; mails that do not parse or are too
    short are dropped after, so fewer rows than ``sample`` may remain.
    """
    listed = root.select("path") if isinstance(root, DataFrame) else list_mail_paths(spark, root)
    paths = sample_rows(listed, sample, seed, key="path")
    mails = min_length_filter(read_mail(paths))
    return mails.select("*", heuristic_label(F.col("text")).alias("label"))


def benchmark_archive(spark: SparkSession, root: str | DataFrame, scorers: Sequence[Scorer], sample: int | None = None,
                      seed: int | str = 0, detailed: bool = True,
                      summary_models: Sequence[str] | None = None,
                      dataset: str = "mail archive (keyword labels)") -> Benchmark:
    """:func:`benchmark` over a mail archive, or a sample of it, labelled by keywords.

    By default the second scorer alone is summarised (the first, if there is but one)
    and the details cover all of them.
    """
    mails = stage(archive_dataset(spark, root, sample, seed), "archive")
    if summary_models is None:
        summary_models = _names(scorers)[1:2] or _names(scorers)
    result = benchmark(mails, scorers, detailed=detailed, key="path", summary_models=summary_models)
    summary = result.summary.select(
        F.lit(dataset).alias("dataset"), "*", F.lit(ARCHIVE_NOTE).alias("note")
    )
    return result._replace(summary=summary)


def predict(df: DataFrame, scorers: Sequence[Scorer], text: str = "text", key: str = "email_id") -> DataFrame:
    """Key, majority vote and map of all models, over the raw text."""
    scored = score_all(df.select(key, F.coalesce(text, F.lit("")).alias("text")), scorers)
    return scored.select(
        key,
        ensemble_vote(labels_of(_names(scorers))).alias("final_prediction"),
        models_map(_names(scorers)).alias("models"),
    )


def benchmark_single(df: DataFrame, scorer: Scorer, text: str = "text", null_as: str = "",
                     labels: DataFrame | None = None, key: str = "email_id") -> DataFrame:
    """Metrics of one model over the raw text; labels in ``df``, or in a table of their own."""
    raw = F.coalesce(text, F.lit(null_as)).alias("text")
    if labels is None:
        return metrics_of(score_all(df.select(raw, "label"), [scorer]), [scorer])
    return metrics_of(score_all(df.select(key, raw), [scorer]).join(labels.select(key, "label"), key), [scorer])
