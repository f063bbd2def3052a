"""From logits to a label with its confidence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailbench.functions.labels import NOT_SPAM, SPAM

# Fixed value: digits kept in confidences and metrics.
DIGITS = 4


def round_n(x: Column, n: int = DIGITS) -> Column:
    """Round half to even."""
    return F.bround(x, n)


def softmax_decide(logits: Column | Sequence[Column]) -> Column:
    """``struct<label, confidence>`` of the largest logit.

    Class 1 is spam and all others are not; equal logits go to the first class.  The
    chosen class has the largest logit, so its probability is 1 / sum(exp(x - max)).

    An array column may have any length.  A list of columns, one per class, gives plain
    arithmetic that Spark compiles together with its surroundings.
    """
    if isinstance(logits, Column):
        top = F.array_max(logits)
        total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        is_spam = F.array_position(logits, top) == 2
    else:
        top = F.greatest(*logits)
        total = reduce(add, [F.exp(x - top) for x in logits])
        is_spam = (logits[1] == top) & (logits[0] != top)
    return F.struct(
        F.when(is_spam, SPAM).otherwise(NOT_SPAM).alias("label"),
        round_n(F.lit(1.0) / total).alias("confidence"),
    )
