import random

import pytest
from pyspark.sql import functions as F

from mailbench.operators.metrics import (
    best_model,
    confusion,
    latency_summary,
    model_metrics,
    summary_record,
    with_summary,
)

LONG = "model string, ordinal int, pred int, label int"


def long_rows(spark, pairs, model="m", ordinal=0):
    return spark.createDataFrame([(model, ordinal, p, t) for p, t in pairs], LONG)


def test_counts_and_metrics(spark):
    pairs = [(1, 1)] * 3 + [(1, 0)] * 1 + [(0, 1)] * 2 + [(0, 0)] * 4
    row = model_metrics(confusion(long_rows(spark, pairs))).first()
    assert (row.n, row.tp, row.fp, row.fn, row.tn) == (10, 3, 1, 2, 4)
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.7, 0.75, 0.6, 0.6667)


@pytest.mark.parametrize("pairs, expected", [
    ([(0, 1), (0, 0)], (0.5, 0.0, 0.0, 0.0)),  # nothing predicted positive
    ([(1, 0), (0, 0)], (0.5, 0.0, 0.0, 0.0)),  # no positives
    ([(0, 0)], (1.0, 0.0, 0.0, 0.0)),
])
def test_zero_denominators(spark, pairs, expected):
    row = model_metrics(confusion(long_rows(spark, pairs))).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == expected


def test_empty_input(spark):
    empty = long_rows(spark, [(1, 1)]).filter("pred > 5")
    assert confusion(empty).count() == 0
    row = model_metrics(confusion(empty, by=[])).first()
    assert row.n == 0 and row.accuracy is None and row.f1 == 0.0


def test_best_model_ties_go_to_registry_order(spark):
    df = spark.createDataFrame([("b", 0, 0.5), ("a", 1, 0.5), ("c", 2, 0.4)], "model string, ordinal int, f1 double")
    assert best_model(df).first().best_model == "b"
    df = spark.createDataFrame([("b", 0, 0.5), ("a", 1, 0.6)], "model string, ordinal int, f1 double")
    assert best_model(df).first().best_model == "a"


def test_summaries(spark):
    both = long_rows(spark, [(1, 1), (0, 0)], "x", 0).union(long_rows(spark, [(1, 1), (1, 0)], "y", 1))
    metrics = model_metrics(confusion(both))
    rows = {r.model: r for r in with_summary(metrics).collect()}
    assert rows["x"].dataset_size == rows["y"].dataset_size == 2
    assert {r.best_model for r in rows.values()} == {"x"}
    record = summary_record(metrics).first()
    assert record.best_model == "x" and record.metrics["y"].precision == 0.5


def test_latency(spark):
    df = spark.createDataFrame([(0.25,), (None,), (1.5,)], "latency_sec double")
    assert tuple(latency_summary(df).first()) == (0.583, 3)
    assert tuple(latency_summary(df.filter("latency_sec > 9")).first()) == (0.0, 0)


def test_counts_add_up_whatever_the_partitioning(spark):
    draw = random.Random(5)
    pairs = [(draw.randint(0, 1), draw.randint(0, 1)) for _ in range(500)]
    df = long_rows(spark, pairs)
    results = {tuple(model_metrics(confusion(df.repartition(n))).first()) for n in (1, 3, 8)}
    assert len(results) == 1
    row = model_metrics(confusion(df)).first()
    assert row.tp + row.fp + row.fn + row.tn == row.n == 500
    precision = sum(p & t for p, t in pairs) / sum(p for p, _ in pairs)
    assert row.precision == pytest.approx(precision, abs=1e-4)
    assert df.select(F.avg((F.col("pred") == F.col("label")).cast("int"))).first()[0] == pytest.approx(
        row.accuracy, abs=1e-4)


def test_rows_without_truth_are_not_counted_silently(spark):
    df = spark.createDataFrame([(1, 1), (0, None)], "pred int, label int")
    with pytest.raises(Exception, match="no label"):
        confusion(df, by=[]).collect()
