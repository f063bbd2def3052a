"""Reports on structured classification: bulk analysis, benchmark, comparison."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailbench.functions.decisions import round_n
from mailbench.functions.text import PREVIEW_CHARS, prefix
from mailbench.operators.classify import classify_llm, classify_llm_spam, with_concurrency
from mailbench.operators.limits import head_by_class, limit_rows
from mailbench.operators.metrics import accuracy, confusion, latency_summary
from mailbench.operators.reshape import flatten_result, rename_llm_columns
from mailbench.operators.scorers import Scorer, score_all
from mailbench.session import stage
from mailbench.sinks.reports import write_report
from mailbench.sources.mail import class_paths, read_class_folders

# Rows compared, and e-mails of a corpus classified, by the described service.
COMPARED = 20
CORPUS = 100


class Report(NamedTuple):
    """Per-e-mail rows, a one-row summary, how the calls went, and where the rows were written."""

    rows: DataFrame
    summary: DataFrame
    calls: DataFrame
    location: str | None = None


def _answer(df: DataFrame, open_client: Callable[[], Any], variant: str, guard: str | None,
            concurrency: int | None, key: str, calls_per_task: int, journal: str | None) -> DataFrame:
    """Make the calls, once, and store what they gave; of bodies only the preview is kept."""
    # With a journal the calls are dealt by what is asked, to as many tasks.
    spread = df if concurrency is None or journal else with_concurrency(df, concurrency)
    answered = classify_llm(spread, open_client, variant, guard, key=key, calls_per_task=calls_per_task,
                            journal=journal, concurrency=concurrency)
    preview = prefix(F.coalesce("body", F.lit("")), PREVIEW_CHARS)
    return stage(answered.withColumn("body", preview), f"answers-{variant}")


def _report(answered: DataFrame, rows: DataFrame, summary: DataFrame, folder: str | None, kind: str,
            fmt: str, key: str, ordered: bool) -> Report:
    calls = answered.select(key, "attempts", "error", "violations", "reply")
    if folder is None:
        return Report(rows, summary, calls)
    location = write_report(rows, folder, kind, fmt, order_by=key if ordered else None).location
    return Report(rows, summary.withColumn("location", F.lit(location)), calls, location)


def analyze_bulk(df: DataFrame, open_client: Callable[[], Any], variant: str = "v1",
                 concurrency: int | None = None, folder: str | None = None, fmt: str = "parquet",
                 key: str = "email_id", ordered: bool = False, calls_per_task: int = 1,
                 journal: str | None = None) -> Report:
    """Classify EMAIL_IN rows and report on each.

    ``v1`` guards e-mails without body and counts; ``v2`` sends everything, reports
    latencies and their mean.  Calls are bounded by ``concurrency`` tasks, if given, of
    ``calls_per_task`` calls each.  The calls
    are made here; rows, summary and calls read what was stored.  ``ordered`` writes the
    report in the order of the keys.  A ``journal`` folder keeps each call as it ends, so that neither a lost task nor
    a job that is run again repeats it.
    """
    answered = _answer(df, open_client, variant, "record" if variant == "v1" else None, concurrency, key, calls_per_task, journal)
    rows = flatten_result(answered, f"bulk_{variant}", key)
    if variant == "v1":
        total = answered.agg(F.count("*").alias("total_emails"))
        return _report(answered, rows, total, folder, "email_analysis", fmt, key, ordered)
    return _report(answered, rows, latency_summary(answered), folder, "bulk", fmt, key, ordered)


def benchmark_llm(df: DataFrame, open_client: Callable[[], Any], variant: str = "v1",
                  concurrency: int | None = None, folder: str | None = None, fmt: str = "parquet",
                  key: str = "email_id", ordered: bool = False, calls_per_task: int = 1,
                  journal: str | None = None) -> Report:
    """Classify labelled e-mails and compare with the labels; no guard.

    The summary has accuracy (null for no e-mails) and total_samples.  ``journal`` as in :func:`analyze_bulk`.
    """
    answered = _answer(df, open_client, variant, None, concurrency, key, calls_per_task, journal)
    rows = flatten_result(answered, "benchmark", key)
    counts = confusion(rows, by=[], pred="predicted", truth="actual")
    summary = counts.select(round_n(accuracy()).alias("accuracy"), F.col("n").alias("total_samples"))
    return _report(answered, rows, summary, folder, "benchmark", fmt, key, ordered)


def benchmark_class_folders(spark: SparkSession, root: str, open_client: Callable[[], Any],
                            variant: str = "v1", n: int | None = None, **options) -> Report:
    """:func:`benchmark_llm` over a class-folder corpus, or its first ``n`` e-mails.

    Paths are chosen before any file is opened; a chosen file that cannot be read is
    left out and not replaced.
    """
    paths = head_by_class(class_paths(spark, root), n)
    return benchmark_llm(read_class_folders(spark, root, paths=paths), open_client, variant,
                         key="path", **options)


def compare(df: DataFrame, scorer: Scorer, open_client: Callable[[], Any],
            limit: int | None = None, key: str = "email_id", null_as: str = "", journal: str | None = None) -> Report:
    """A classifier and a language model side by side over the raw text; ``journal`` as in :func:`analyze_bulk`."""
    text = F.coalesce("text", F.lit(null_as)).alias("text")
    chosen = limit_rows(df, limit, key).select(key, text, "label")
    answered = stage(classify_llm_spam(score_all(chosen, [scorer]), open_client, key=key, journal=journal), "compare")
    rows = rename_llm_columns(answered, ml=scorer.name, key=key)
    return _report(answered, rows, answered.agg(F.count("*").alias("samples")), None, "", "", key, False)
