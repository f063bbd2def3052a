import random

import pytest
from pyspark.sql import functions as F

from mailbench.functions.labels import correct, label_to_text, text_to_label
from mailbench.functions.text import (
    WHITESPACE,
    compose_for,
    compose_text,
    heuristic_label,
    llm_prompt_v1,
    llm_prompt_v2,
    min_length_filter,
    prefix,
    strip_text,
)


def test_compose_template_and_limits(one):
    got = one(
        compose_text(F.col("subject"), F.col("sender"), F.col("body")),
        subject="s" * 250, sender="f" * 150, body="b" * 1200,
    )
    assert got == (
        "\n    From: " + "f" * 100 + "\n    Subject: " + "s" * 200 + "\n    Body: " + "b" * 1000 + "\n    "
    )


def test_compose_absent_and_missing_values(spark):
    df = spark.createDataFrame([(None, "t")], "`from` string, text string")
    assert df.select(compose_for(df)).first()[0] == "\n    From: \n    Subject: \n    Body: t\n    "
    assert df.select(compose_for(df, null_as="nan")).first()[0] == (
        "\n    From: nan\n    Subject: \n    Body: t\n    "
    )


@pytest.mark.parametrize("text, n", [("a😀é👍🏽b", 4), ("abc", 5), ("", 3), ("é" * 10, 9)])
def test_prefix_counts_code_points(one, text, n):
    assert one(prefix(F.col("t"), n), t=text) == text[:n]


def test_prompt_v1_cuts_body_only(one):
    got = one(llm_prompt_v1(F.col("s"), F.col("b")), s="S" * 4000, b="x" * 3500)
    assert got == "\nEmail Subject: " + "S" * 4000 + "\nEmail Body: " + "x" * 3000 + "\n"


def test_prompt_v2_strips_before_cutting(one):
    prompt = llm_prompt_v2(F.col("s"), F.col("b"))
    assert one(prompt, s="S", b=" " * 10 + "x" * 6000) == "Subject: S\n\nBody:\n" + "x" * 6000
    assert one(prompt, s="S", b="x" * 6001) == "Subject: S\n\nBody:\n" + "x" * 6000


def test_strip_equals_python(one):
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
    for text in (
        "\x00   hi\x00 there　\n", "", "  ", "\x1c\x1fa​", "\x00", "a \x00", WHITESPACE + "b" + WHITESPACE,
    ):
        assert one(strip_text(F.col("t")), t=text) == text.replace("\x00", "").strip()


def test_min_length_is_exclusive(spark):
    df = spark.createDataFrame([("x" * 20,), ("x" * 21,), (None,)], "text string")
    assert [r.text for r in min_length_filter(df).collect()] == ["x" * 21]


@pytest.mark.parametrize("text, label", [
    ("a window seat", 1), ("nothing here", 0), ("FREE", 1), ("moneymaker", 1), ("offering", 1), ("", 0), (None, 0),
])
def test_heuristic_label(one, text, label):
    assert one(heuristic_label(F.col("t")), t=text) == label


def test_heuristic_ignores_subject(spark):
    df = spark.createDataFrame([("free money", "see you")], "subject string, text string")
    assert df.select(heuristic_label(F.col("text"))).first()[0] == 0


def test_labels(spark):
    df = spark.createDataFrame([(1, "spam"), (0, "not spam"), (7, "ham"), (None, None)], "n int, t string")
    assert [r[0] for r in df.select(label_to_text(F.col("n"))).collect()] == [
        "spam", "not spam", "not spam", "not spam"]
    assert [r[0] for r in df.select(text_to_label(F.col("t"))).collect()] == [1, 0, 0, 0]
    assert [r[0] for r in df.select(label_to_text(F.col("t") == "spam")).collect()][:2] == ["spam", "not spam"]


def test_correct_is_never_null(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), (None, None)], "p string, t string")
    assert [r[0] for r in df.select(correct(F.col("p"), F.col("t"))).collect()] == [True, False, True]


def test_random_texts_agree_with_python(spark):
    draw = random.Random(11)
    alphabet = WHITESPACE + "\x00abcÄß€😀👍🏽\u200b\u0301freewinmoneyoffer"
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select(
        "i", strip_text(F.col("t")).alias("stripped"), prefix("t", 7).alias("cut"),
        F.length("t").alias("n"), heuristic_label(F.col("t")).alias("hit"),
    ).collect()
    for row in rows:
        text = texts[row.i]
        assert row.stripped == text.replace("\x00", "").strip()
        assert (row.cut, row.n) == (text[:7], len(text))
        assert row.hit == int(any(w in text.lower() for w in ("free", "win", "money", "offer")))
