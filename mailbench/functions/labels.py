"""Conversion between 0/1 labels and label texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two label texts.
SPAM = "spam"
NOT_SPAM = "not spam"


def label_to_text(label: Column) -> Column:
    """1 (or true) is spam; every other value, null included, is not."""
    return F.when(label.cast("int") == 1, SPAM).otherwise(NOT_SPAM)


def text_to_label(text: Column) -> Column:
    return F.when(text == SPAM, 1).otherwise(0)


def correct(prediction: Column, truth: Column) -> Column:
    """Whether both agree; never null."""
    return prediction.eqNullSafe(truth)
