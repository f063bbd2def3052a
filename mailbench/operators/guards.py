"""Constant records for e-mails without text, for which no model is called.

Scorers and model calls test :func:`is_empty` where the batch is formed, so guarded
rows never reach the model and the input is still scanned only once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailbench.functions.labels import NOT_SPAM
from mailbench.schemas import LLM_OUT, PREDICTION

# What an e-mail without text gets.
EMPTY_PREDICTION = {"label": NOT_SPAM, "confidence": 0.0, "error": None}
EMPTY_RECORD = {
    "intent": "empty",
    "is_spam": False,
    "is_system_generated": False,
    "reason": "empty body",
    "category": "none",
    "priority": "low",
    "confidence": 0.0,
}
EMPTY_ERROR = "Email body is required"


def is_empty(text: Column) -> Column:
    """Null or ''; a blank text is not empty."""
    return F.coalesce(text, F.lit("")) == ""


def constant(values: dict, ddl: str) -> Column:
    """A struct literal with the field types of ``ddl``."""
    fields = []
    for part in ddl.split(","):
        name, kind = part.split()
        fields.append(F.lit(values[name]).cast(kind).alias(name))
    return F.struct(*fields)


def empty_guard(text: Column, otherwise: Column, kind: str = "classifier") -> Column:
    """The constant of ``kind`` for empty texts, ``otherwise`` for all others.

    ``classifier`` gives a prediction, ``label`` its label only, ``record`` the
    seven-field record, ``error`` the message of a rejected e-mail.
    """
    constants = {
        "classifier": constant(EMPTY_PREDICTION, PREDICTION),
        "label": F.lit(NOT_SPAM),
        "record": constant(EMPTY_RECORD, LLM_OUT),
        "error": F.lit(EMPTY_ERROR),
    }
    return F.when(is_empty(text), constants[kind]).otherwise(otherwise)


def guard_prediction(text: Column, prediction: Column) -> Column:
    """:func:`empty_guard` of each field of a prediction."""
    empty = is_empty(text)
    return F.struct(*[
        F.when(empty, F.lit(value)).otherwise(prediction[name]).alias(name)
        for name, value in EMPTY_PREDICTION.items()
    ])
