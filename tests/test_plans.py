import json
import os

import numpy as np
import pytest

from mailbench.catalog import fixtures as fx
from mailbench.operators.scorers import BatchScorer
from mailbench.plans import classifiers, structured
from mailbench.session import stage
from mailbench.streaming import analyze_stream, read_stream


class CountingClient(fx.StubClient):
    def __init__(self, log):
        super().__init__()
        self.log = log

    def send(self, request):
        with open(self.log, "a") as f:
            f.write(f"{request.key}\n")
        return super().send(request)


def counting_scorer(name, log):
    def load(max_tokens):
        def model(texts):
            with open(log, "a") as f:
                f.writelines(f"{name}\n" for _ in texts)
            return np.tile([0.0, 1.0], (len(texts), 1))

        return model

    return BatchScorer(name, load)


def lines(log):
    return log.read_text().split() if log.exists() else []


@pytest.fixture
def mail(spark):
    rows = [(i, f"from{i}", f"subject{i}", f"text {i} trash" if i % 3 == 0 else f"text {i}", int(i % 3 == 0))
            for i in range(1, 31)]
    return spark.createDataFrame(rows, "email_id long, sender string, subject string, text string, label int")


def test_each_text_is_scored_once_per_model(spark, mail, tmp_path):
    log = tmp_path / "calls"
    scorers = [counting_scorer(n, str(log)) for n in ("a", "b")]
    result = classifiers.benchmark(mail, scorers, detailed=True)
    for frame in (result.metrics, result.summary, result.details, result.metrics):
        frame.collect()
    assert sorted(lines(log)) == ["a"] * 30 + ["b"] * 30


def test_benchmark_numbers(spark, mail):
    result = classifiers.benchmark(mail, fx.native_scorers(), detailed=True)
    metrics = {r.model: r for r in result.metrics.collect()}
    assert (metrics["m1"].tp, metrics["m1"].fn, metrics["m2"].tp, metrics["m2"].fn) == (10, 0, 0, 10)
    summary = result.summary.first()
    assert (summary.dataset_size, summary.best_model, summary.metrics["m3"].f1) == (30, "m1", 1.0)
    row = result.details.filter("email_id = 3").first()
    assert row.text == "\n    From: from3\n    Subject: subject3\n    Body: text 3 trash\n    "
    assert (row.true_label, row.ensemble_prediction, row.ensemble_correct) == ("spam", "spam", True)
    assert row.models["m2"].label == "not spam" and not row.models["m2"].correct


def test_benchmark_limit_and_size(mail):
    for limit, size in ((None, 30), (0, 30), (7, 7), (-7, 23)):
        assert classifiers.benchmark(mail, fx.native_scorers(), limit).summary.first().dataset_size == size


def test_one_model_is_its_own_ensemble(mail):
    scorer = fx.native_scorers()[:1]
    for row in classifiers.predict(mail, scorer).collect():
        assert row.final_prediction == row.models["m1"].label


def test_metrics_do_not_depend_on_partitions(mail):
    found = {
        tuple(sorted(map(tuple, classifiers.benchmark(mail.repartition(n), fx.native_scorers()).metrics.collect())))
        for n in (1, 2, 5)
    }
    assert len(found) == 1


def test_predict_guards_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "trash idiot")], "email_id long, text string")
    got = {r.email_id: r for r in classifiers.predict(df, fx.native_scorers()).collect()}
    assert got[1].final_prediction == got[2].final_prediction == "not spam"
    assert got[1].models["m1"].confidence == 0.0 and got[3].final_prediction == "spam"


def test_archive_summarises_one_model_and_details_all(spark, tmp_path):
    for i in range(12):
        folder = tmp_path / ("_sent" if i % 2 else "inbox")
        folder.mkdir(exist_ok=True)
        (folder / f"{i}.").write_text(f"From: f{i}\nSubject: s{i}\n\n" + ("short" if i == 0 else f"a longer text with money {i}"))
    result = classifiers.benchmark_archive(spark, str(tmp_path), fx.native_scorers(), sample=100)
    summary = result.summary.first()
    assert list(summary.metrics) == ["m2"] and summary.best_model == "m2" and summary.dataset_size == 11
    assert "keyword" in summary.dataset and summary.note
    rows = result.details.collect()
    assert len(rows) == 11 and all(list(r.models) == ["m1", "m2", "m3"] for r in rows)
    assert {r.true_label for r in rows} == {"spam"}
    few = classifiers.benchmark_archive(spark, str(tmp_path), fx.native_scorers(), sample=5, seed=1, detailed=False)
    assert few.details is None and few.summary.first().dataset_size in (4, 5)
    again = classifiers.archive_dataset(spark, str(tmp_path), 5, 1)
    assert again.count() == few.summary.first().dataset_size


def test_bulk_calls_once_per_mail(spark, mail, tmp_path):
    log = tmp_path / "calls"
    report = structured.analyze_bulk(
        mail.withColumnRenamed("text", "body"), lambda: CountingClient(str(log)), "v2", concurrency=3,
        folder=str(tmp_path / "out"), fmt="csv")
    summary = report.summary.first()
    report.rows.collect()
    calls = lines(log)
    assert len(set(calls)) == 30
    assert sorted(calls) == sorted([str(i) for i in range(1, 31)] + ["7"] * 2 + ["13"] * 2 + ["11"])
    assert summary.total_processed == 30 and summary.location == report.location
    assert report.location.startswith(str(tmp_path / "out" / "bulk_")) and os.path.isdir(report.location)
    assert summary.avg_latency_sec == round((27 * 0.25 + 2 * 2.75 + 1.5) / 30, 3)


def test_ordered_report(spark, mail, tmp_path):
    report = structured.analyze_bulk(mail.withColumnRenamed("text", "body").repartition(4), fx.StubClient, "v1",
                                     folder=str(tmp_path), ordered=True)
    parts = sorted(n for n in os.listdir(report.location) if n.startswith("part-"))
    written = [r.email_id for n in parts for r in spark.read.parquet(f"{report.location}/{n}").collect()]
    assert written == list(range(1, 31))


def test_metrics_with_labels_in_another_table(spark, mail):
    scorers = [*fx.native_scorers(), fx.batch_scorer()]
    unlabelled = spark.createDataFrame([(99, "", "", "trash")], "email_id long, sender string, subject string, text string")
    texts = mail.drop("label").unionByName(unlabelled)
    for threshold in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            apart = classifiers.metrics_of_label_table(texts, mail.select("email_id", "label"), scorers).collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        together = classifiers.benchmark(mail, scorers).metrics.collect()
        assert sorted(map(tuple, apart)) == sorted(map(tuple, together))


def test_llm_benchmark_of_nothing(spark, mail):
    empty = mail.filter("email_id > 99").withColumnRenamed("text", "body")
    summary = structured.benchmark_llm(empty, fx.StubClient).summary.first()
    assert (summary.accuracy, summary.total_samples) == (None, 0)


class AnyKeyClient(fx.StubClient):
    def send(self, request):
        assert request.key.endswith(".txt")
        return {"intent": "i", "is_spam": "buy" in request.prompt, "is_system_generated": False, "reason": None,
                "category": "c", "priority": "low", "confidence": 1}


def test_class_folder_benchmark(spark, tmp_path):
    for name in ("spam/1", "spam/2", "ham/1", "ham/2"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.txt").write_text("buy" if name in ("spam/1", "ham/2") else "hello")
    run = lambda n: structured.benchmark_class_folders(spark, str(tmp_path), AnyKeyClient, "v2", n)
    report = run(3)
    assert {(os.path.basename(os.path.dirname(r.path)), r.actual, r.predicted, r.correct) for r in report.rows.collect()} == {
        ("spam", 1, 1, True), ("spam", 1, 0, False), ("ham", 0, 0, True)}
    assert tuple(report.summary.first()) == (0.6667, 3)
    assert tuple(run(100).summary.first()) == (0.5, 4)


def test_compare_columns_and_default_limit(mail):
    report = structured.compare(mail, fx.native_scorers()[0], fx.StubClient, structured.COMPARED)
    assert report.rows.columns[1:] == [
        "text", "true_label", "ml_prediction", "ml_correct", "llm_prediction", "llm_correct",
        "llm_category", "llm_intent", "llm_confidence", "llm_reason"]
    assert report.summary.first().samples == report.rows.count() == 20


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    arrived, out, rejects, state = (str(tmp_path / n) for n in ("arrived", "out", "rejects", "state"))
    log = tmp_path / "calls"
    os.mkdir(arrived)

    def arrive(name, ids):
        with open(f"{arrived}/{name}.json", "w") as f:
            for i in ids:
                f.write(json.dumps({"email_id": i, **({} if i % 4 == 0 else {"body": f"body {i}"})}) + "\n")

    def run():
        score = lambda df: structured.classify_llm(df, lambda: CountingClient(str(log)), "v1", "record")
        for query in analyze_stream(read_stream(spark, arrived, 1), score, out, state, rejects):
            query.awaitTermination()

    arrive("a", range(1, 6))
    arrive("b", range(21, 26))
    run()
    arrive("c", range(31, 36))
    run()
    accepted = {i for i in [*range(1, 6), *range(21, 26), *range(31, 36)] if i % 4}
    assert {r.email_id for r in spark.read.parquet(out).collect()} == accepted
    assert {r.email_id for r in spark.read.parquet(rejects).collect()} == {4, 24, 32}
    assert sorted(lines(log)) == sorted(str(i) for i in accepted)  # nothing is sent twice


def test_stream_writes_both_halves_once(spark, tmp_path, monkeypatch):
    """A run dies between the two writes; the next one loses and doubles nothing and asks nothing again, with one reading per batch."""
    from mailbench.streaming import analyze

    arrived, out, rejects, state = (str(tmp_path / n) for n in ("arrived", "out", "rejects", "state"))
    log, staged = tmp_path / "calls", []
    os.mkdir(arrived)
    for name in "ab":
        with open(f"{arrived}/{name}.json", "w") as f:
            for i in range(6):
                f.write(json.dumps({"email_id": ord(name) * 100 + i, **({} if i % 3 == 0 else {"body": "b"})}) + "\n")
    score = lambda df: structured.classify_llm(df, lambda: CountingClient(str(log)), "v1", "record")
    real, checks = analyze.finished, []

    def dies_once(spark_, path):
        checks.append(path)
        if len(checks) == 2:  # of the first batch: results are written, rejects are not
            raise RuntimeError("driver lost")
        return real(spark_, path)

    monkeypatch.setattr(analyze, "finished", dies_once)
    monkeypatch.setattr(analyze, "stage", lambda df, name: staged.append(name) or stage(df, name))
    (query,) = analyze_stream(read_stream(spark, arrived, 1), score, out, state, rejects)
    with pytest.raises(Exception):
        query.awaitTermination()
    (query,) = analyze_stream(read_stream(spark, arrived, 1), score, out, state, rejects)
    query.awaitTermination()
    ids = [ord(n) * 100 + i for n in "ab" for i in range(6)]
    assert sorted(r.email_id for r in spark.read.parquet(out).collect()) == [i for i in ids if i % 100 % 3]
    assert sorted(r.email_id for r in spark.read.parquet(rejects).collect()) == [i for i in ids if i % 100 % 3 == 0]
    assert sorted(lines(log)) == sorted(str(i) for i in ids if i % 100 % 3) and len(staged) == 3
