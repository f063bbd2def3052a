"""Bounded texts and prompts built from subject, sender and body."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Character limits of the composed text.
SUBJECT_CHARS = 200
SENDER_CHARS = 100
BODY_CHARS = 1000

# Characters of the body sent to a language model, and of a report preview.
PROMPT_V1_CHARS = 3000
PROMPT_V2_CHARS = 6000
PREVIEW_CHARS = 200

# Shortest text kept is one character longer; keywords of the heuristic label.
MIN_CHARS = 20
SPAM_WORDS = ("free", "win", "money", "offer")

# Characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def prefix(text: Column | str, n: int) -> Column:
    """First ``n`` code points."""
    return F.substring(text, 1, n)


def compose_text(subject: Column, sender: Column, body: Column) -> Column:
    """The text a classifier scores: sender, subject and body, each cut to its limit."""
    return F.concat(
        F.lit("\n    From: "), prefix(sender, SENDER_CHARS),
        F.lit("\n    Subject: "), prefix(subject, SUBJECT_CHARS),
        F.lit("\n    Body: "), prefix(body, BODY_CHARS),
        F.lit("\n    "),
    )


def compose_for(df: DataFrame, null_as: str = "") -> Column:
    """:func:`compose_text` over the columns ``df`` has.

    An absent column counts as ''.  A missing value becomes ``null_as``; pass
    ``'nan'`` to get the text a pandas string conversion would have produced.
    """

    def pick(*names: str) -> Column:
        for name in names:
            if name in df.columns:
                return F.coalesce(F.col(name), F.lit(null_as))
        return F.lit("")

    return compose_text(pick("subject"), pick("sender", "from"), pick("text"))


def strip_text(text: Column) -> Column:
    """Drop NUL characters, then leading and trailing Unicode white space."""
    return F.btrim(F.translate(text, "\x00", ""), F.lit(WHITESPACE))


def llm_prompt_v1(subject: Column, body: Column) -> Column:
    return F.concat(
        F.lit("\nEmail Subject: "), subject,
        F.lit("\nEmail Body: "), prefix(body, PROMPT_V1_CHARS),
        F.lit("\n"),
    )


def llm_prompt_v2(subject: Column, body: Column) -> Column:
    """The body is cleaned first and cut afterwards."""
    return F.concat(
        F.lit("Subject: "), subject,
        F.lit("\n\nBody:\n"), prefix(strip_text(body), PROMPT_V2_CHARS),
    )


def min_length_filter(df: DataFrame, text: str = "text", n: int = MIN_CHARS) -> DataFrame:
    """Rows whose text has more than ``n`` characters; null texts go too."""
    return df.filter(F.length(text) > n)


def heuristic_label(text: Column, words: Sequence[str] = SPAM_WORDS) -> Column:
    """1 if any word occurs anywhere in the lower-cased text, else 0."""
    lowered = F.lower(text)
    found = F.lit(False)
    for word in words:
        found = found | F.contains(lowered, F.lit(word))
    return F.coalesce(found, F.lit(False)).cast("int")
