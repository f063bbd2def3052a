"""Every registered query against its SQL, and known results."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from mailbench.catalog import fixtures as fx
from mailbench.catalog.oracle import oracle
from mailbench.catalog.queries import QUERIES
from mailbench.operators.ensemble import labels_of, ensemble_vote
from mailbench.plans import classifiers
from mailbench.operators.scorers import score_all
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SQL = oracle()


@pytest.fixture(scope="module")
def database(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    yield connection
    connection.close()


def canonical(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def cell(value):
        if value is None or isinstance(value, float) and math.isnan(value):
            return "∅"
        return f"{float(value):.9g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf_dir, database, name):
    found = QUERIES[name](spark, sf_dir)
    expected = database.execute(SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(names)
    assert canonical(found.collect(), found.columns) == canonical(expected.fetchall(), names)


def test_entry(spark):
    assert contract.entry(spark).count() == 3


# model: n, tp, fp, fn, tn, accuracy, precision, recall, f1
RAW = {
    "m1": (87, 6, 0, 5, 76, 0.9425, 1.0, 0.5455, 0.7059),
    "m2": (87, 7, 0, 4, 76, 0.954, 1.0, 0.6364, 0.7778),
    "m3": (87, 5, 0, 6, 76, 0.931, 1.0, 0.4545, 0.625),
    "m4": (87, 4, 19, 7, 57, 0.7011, 0.1739, 0.3636, 0.2353),
}
COMPOSED = {
    "m1": (87, 4, 0, 7, 76, 0.9195, 1.0, 0.3636, 0.5333),
    "m2": (87, 6, 0, 5, 76, 0.9425, 1.0, 0.5455, 0.7059),
    "m3": (87, 3, 0, 8, 76, 0.908, 1.0, 0.2727, 0.4286),
}


def by_model(metrics):
    return {r.model: tuple(r)[2:] for r in metrics.collect()}


def test_golden_metrics(spark, sf_dir):
    emails = fx.emails(spark, sf_dir)
    scorers = fx.native_scorers(with_noisy=True)
    assert by_model(classifiers.metrics_of(score_all(emails, scorers), scorers)) == RAW
    assert by_model(classifiers.benchmark(emails, scorers[:3]).metrics) == COMPOSED


def test_golden_ensemble(spark, sf_dir):
    scored = score_all(fx.emails(spark, sf_dir), fx.native_scorers())
    vote = ensemble_vote(labels_of(["m1", "m2", "m3"])) == "spam"
    row = scored.agg(F.count_if(vote & (F.col("label") == 1)), F.count_if(vote & (F.col("label") == 0))).first()
    assert tuple(row) == (6, 0)


def test_keyword_label_on_six_texts(spark):
    """Our own rows with the outcome stated for such a set: one hit, two misses."""
    from mailbench.functions.text import heuristic_label
    from mailbench.operators.metrics import confusion, model_metrics

    texts = [("win this", 1), ("a prize", 1), ("lunch at noon", 0), ("see the file", 0), ("claim it", 1), ("next week", 0)]
    df = spark.createDataFrame(texts, "text string, label int")
    row = model_metrics(confusion(df.withColumn("pred", heuristic_label(F.col("text"))), by=[])).first()
    assert tuple(row) == (6, 1, 0, 2, 3, 0.6667, 1.0, 0.3333, 0.5)
