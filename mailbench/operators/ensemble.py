"""Combining the predictions of several scorers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailbench.functions.labels import NOT_SPAM, SPAM, correct, text_to_label


def ensemble_vote(labels: Column | Sequence[Column]) -> Column:
    """'spam' if strictly more than half of the labels say so.

    ``labels`` is an array column, or a list of columns, one per model.
    """
    if isinstance(labels, Column):
        votes, spam = F.size(labels), F.size(F.filter(labels, lambda label: label == SPAM))
    else:
        votes, spam = F.lit(len(labels)), reduce(add, [text_to_label(label) for label in labels])
    return F.when(spam * 2 > votes, SPAM).otherwise(NOT_SPAM)


def labels_of(names: Sequence[str]) -> list[Column]:
    return [F.col(name)["label"] for name in names]


def models_map(names: Sequence[str], truth: Column | None = None) -> Column:
    """Map from model to label and confidence, and to ``correct`` if the truth is given."""
    entries = []
    for name in names:
        fields = [F.col(name)["label"].alias("label"), F.col(name)["confidence"].alias("confidence")]
        if truth is not None:
            fields.append(correct(F.col(name)["label"], truth).alias("correct"))
        entries += [F.lit(name), F.struct(*fields)]
    return F.create_map(*entries)


def long_predictions(scored: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per e-mail and model: ``keep``, model, ordinal, predicted, confidence, pred, error."""
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("model"),
            F.lit(place).alias("ordinal"),
            F.col(name)["label"].alias("predicted"),
            F.col(name)["confidence"].alias("confidence"),
            text_to_label(F.col(name)["label"]).alias("pred"),
            F.col(name)["error"].alias("error"),
        )
        for place, name in enumerate(names)
    ])
    return scored.select(*keep, F.inline(rows))


def vote_sums(scored: DataFrame, names: Sequence[str], key: str = "email_id") -> DataFrame:
    """Spam votes and all votes per e-mail, from the predictions in its row.  No shuffle."""
    spam = reduce(add, [text_to_label(label) for label in labels_of(names)])
    return scored.select(key, spam.cast("long").alias("spam_votes"), F.lit(len(names)).cast("long").alias("votes"))


def vote_counts(long: DataFrame, key: str = "email_id") -> DataFrame:
    """:func:`vote_sums` of input that arrives with one row per e-mail and model."""
    return long.groupBy(key).agg(
        F.count_if(F.col("predicted") == SPAM).alias("spam_votes"),
        F.count("*").alias("votes"),
    )
