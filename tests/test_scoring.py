import numpy as np
import pytest
from pyspark.sql import functions as F

from mailbench.catalog.fixtures import batch_scorer, load_word_model, native_scorers
from mailbench.functions.decisions import round_n, softmax_decide
from mailbench.operators.ensemble import ensemble_vote, long_predictions, models_map, vote_counts, vote_sums
from mailbench.operators.guards import EMPTY_RECORD, empty_guard, is_empty
from mailbench.operators.scorers import BatchScorer, NativeScorer, padded_batches, score_all, score_transformer, text_slices
from mailbench.plans.classifiers import benchmark, benchmark_single, detailed_results, predict


@pytest.mark.parametrize("logits, label, confidence", [
    ([1.0, 1.0], "not spam", 0.5),
    ([0.1, 2.3], "spam", 0.9002),
    ([0.0, 0.1, 5.0], "not spam", 0.986),
    ([0.0, 5.0, 5.0], "spam", 0.4983),
    ([-800.0, 900.0], "spam", 1.0),
])
def test_softmax_decide(spark, logits, label, confidence):
    df = spark.createDataFrame([(logits,)], "l array<double>")
    columns = [F.col("l")[i] for i in range(len(logits))]
    for source in (F.col("l"), columns):
        got = df.select(softmax_decide(source).alias("d")).first()["d"]
        assert (got.label, got.confidence) == (label, confidence)


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(1 / 32,), (3 / 32,), (0.12344,)], "x double")
    assert [r[0] for r in df.select(round_n(F.col("x"))).collect()] == [0.0312, 0.0938, 0.1234]


@pytest.mark.parametrize("labels, expected", [
    ("sn", "not spam"), ("ssn", "spam"), ("ssnn", "not spam"), ("sssn", "spam"), ("s", "spam"), ("n", "not spam"),
])
def test_ensemble_vote(spark, labels, expected):
    names = ["spam" if x == "s" else "not spam" for x in labels]
    df = spark.createDataFrame([(names,)], "l array<string>")
    assert df.select(ensemble_vote(F.col("l"))).first()[0] == expected
    assert df.select(ensemble_vote([F.col("l")[i] for i in range(len(names))])).first()[0] == expected


def test_guard_is_on_empty_not_on_blank(spark):
    df = spark.createDataFrame([("",), (None,), (" ",)], "t string")
    assert [r[0] for r in df.select(is_empty(F.col("t"))).collect()] == [True, True, False]
    got = df.select(empty_guard(F.col("t"), F.lit(None), "record").alias("r")).collect()
    assert got[0].r.asDict() == EMPTY_RECORD and got[2].r is None


def test_native_scorers_guard_and_label(spark):
    df = spark.createDataFrame([(1, "what TRASH"), (2, ""), (3, None), (4, "fine")], "email_id long, text string")
    got = {r.email_id: r for r in score_all(df, native_scorers()).collect()}
    assert (got[1].m1.label, got[1].m1.confidence, got[1].m2.label) == ("spam", 0.7311, "not spam")
    assert got[2].m1 == got[3].m1 == ("not spam", 0.0, None)
    assert got[4].m3.label == "not spam"


def test_batches_do_not_contain_guarded_texts(spark, tmp_path):
    seen = tmp_path / "seen"

    def load(max_tokens):
        assert max_tokens == 512

        def model(texts):
            with open(seen, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return np.array([[0.0, float(len(t))] for t in texts])

        return model

    rows = [(i, "" if i % 3 == 0 else None if i % 3 == 1 else f"text{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "email_id long, text string").coalesce(1)
    got = {r.email_id: r.model for r in score_transformer(df, "text", load, batch_size=7).collect()}
    assert sorted(seen.read_text().split()) == sorted(f"text{i}" for i in range(2, 30, 3))
    assert got[0] == got[1] == ("not spam", 0.0, None)
    assert got[2] == ("spam", 0.9933, None)


def test_a_failing_text_does_not_take_its_batch_along(spark):
    def load(max_tokens):
        def model(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("cannot score")
            return np.tile([0.0, 3.0], (len(texts), 1))

        return model

    df = spark.createDataFrame([(i, "bad" if i == 4 else "good") for i in range(10)], "email_id long, text string")
    got = {r.email_id: r.model for r in score_transformer(df.coalesce(1), "text", load).collect()}
    assert got.pop(4) == ("not spam", 0.0, "cannot score")
    assert set(got.values()) == {("spam", 0.9526, None)}


def test_class_above_one_is_not_spam(spark):
    scorer = BatchScorer("three", lambda n: lambda texts: np.tile([0.0, 0.1, 5.0], (len(texts), 1)))
    df = spark.createDataFrame([("x",)], "text string")
    assert score_all(df, [scorer]).first().three == ("not spam", 0.986, None)


def test_scorer_names_must_be_distinct(spark):
    df = spark.createDataFrame([("x",)], "text string")
    with pytest.raises(ValueError):
        score_all(df, [NativeScorer("a"), NativeScorer("a")])
    with pytest.raises(ValueError):
        score_all(df, [NativeScorer("text")])


def test_batched_model_is_called_once_per_text_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "email_id long, text string")
    plan = score_all(df, [*native_scorers(), batch_scorer()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_filters_on_predictions_do_not_run_the_model_again(spark, tmp_path):
    """30 calls for 30 texts, whatever is filtered on."""
    calls = str(tmp_path / "calls")

    def load(max_tokens):
        model = load_word_model(max_tokens)

        def counted(texts):
            with open(calls, "a") as out:
                out.write("x" * len(texts))
            return model(texts)

        return counted

    df = spark.createDataFrame([(i, "s", "t", "scum" if i % 3 else "fine", i % 2) for i in range(30)],
                               "email_id long, sender string, subject string, text string, label int").coalesce(1)
    scorers = [BatchScorer("model", load)]
    for found in (predict(df, scorers).filter("final_prediction = 'spam'"), detailed_results(df, scorers).filter("NOT ensemble_correct"),
                  score_transformer(df, "text", load).filter("model.label = 'spam'")):
        found.collect()
        with open(calls) as done:
            assert len(done.read()) == 30
        open(calls, "w").close()


def test_labels_meet_answers_not_texts(spark):
    rows = [(i, "s", "t", "scum " * (i % 3), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "email_id long, sender string, subject string, text string, label int")
    labels, texts = df.select("email_id", "label").where("email_id < 35"), df.drop("label")
    both = df.where("email_id < 35")
    want = benchmark(both, native_scorers()).metrics.orderBy("model").collect()
    assert benchmark(texts, native_scorers(), labels=labels).metrics.orderBy("model").collect() == want
    assert benchmark(texts, native_scorers(), labels=labels, only_labelled=True).metrics.orderBy("model").collect() == want
    assert benchmark(texts, native_scorers(), 10, labels=labels).summary.first().dataset_size == 10
    assert sorted(map(str, detailed_results(texts, native_scorers(), labels=labels).collect())) == sorted(map(str, detailed_results(both, native_scorers()).collect()))
    single = benchmark_single(texts, native_scorers()[0], labels=labels)
    assert single.collect() == benchmark_single(both, native_scorers()[0]).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = benchmark_single(texts.repartition(3), native_scorers()[0], labels=labels)._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.index("SortMergeJoin"):]
        exchanged = [line for line in join.split("\n") if "Exchange hashpartitioning" in line]
        assert exchanged and plan.index("SortMergeJoin") < plan.index("text#")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_vote_sums_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, "trash moron"), (2, "x")], "email_id long, text string")
    votes = vote_sums(score_all(df, native_scorers()), ["m1", "m2", "m3"])
    assert sorted(map(tuple, votes.collect())) == [(1, 3, 3), (2, 0, 3)]
    assert "Exchange" not in votes._jdf.queryExecution().executedPlan().toString()


def test_map_and_votes(spark):
    df = spark.createDataFrame([(1, "trash moron"), (2, "x")], "email_id long, text string")
    names = ["m1", "m2", "m3"]
    scored = score_all(df, native_scorers())
    first = scored.orderBy("email_id").select(models_map(names, F.lit("spam")).alias("m")).first().m
    assert list(first) == names and first["m1"].correct and first["m1"].label == "spam"
    assert "correct" not in scored.select(models_map(names).alias("m")).first().m["m1"]
    counts = vote_counts(long_predictions(scored, names, ["email_id"])).orderBy("email_id").collect()
    assert [tuple(r) for r in counts] == [(1, 3, 3), (2, 0, 3)]


def test_padded_batches_bound_the_work():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 512, 1000), rng.zipf(1.6, 700).clip(1, 512), np.full(300, 512), np.array([0, 0, 5]), np.array([], int)):
        groups = padded_batches(lengths, 64 * 512, 1.2)
        assert sorted(i for g in groups for i in g) == list(range(len(lengths)))
        for g in groups:
            own = np.maximum(lengths[g], 1)
            assert len(g) == 1 or own.max() * len(g) <= min(64 * 512, 1.2 * own.sum())


def test_padding_is_little_on_documents(spark, sf_dir, tmp_path):
    """Padded work of a model that pads, over all documents; answers in the order of the rows."""
    log = tmp_path / "work"

    def load(max_tokens):
        class Padding:
            def lengths(self, texts):
                return [len(t.split()) for t in texts]

            def __call__(self, texts):
                sizes = [min(max(len(t.split()), 1), max_tokens) for t in texts]
                with open(log, "a") as f:
                    f.write(f"{max(sizes) * len(sizes)} {sum(sizes)}\n")
                return np.array([[0.0, float(len(t))] for t in texts])

        return Padding()

    df = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS email_id", "text")
    got = score_transformer(df, "text", load).collect()
    assert all(r.model.label == ("spam" if r.text else "not spam") for r in got) and len(got) == df.count()
    padded, real = np.loadtxt(log).reshape(-1, 2).sum(axis=0)
    assert real <= padded <= 1.2 * real


def test_a_failing_text_takes_no_other_along_in_its_batch(spark):
    def load(max_tokens):
        def model(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("cannot score")
            return np.array([[0.0, len(t) / 100] for t in texts])

        return model

    texts = [("bad " if i % 50 == 7 else "ok ") * (1 + i * 37 % 90) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "email_id long, text string").coalesce(1)
    for r in score_transformer(df, "text", load).collect():
        assert (r.model.error is None) == ("bad" not in r.text)
        if r.model.error is None:
            assert r.model.confidence == pytest.approx(1 / (1 + np.exp(-len(r.text) / 100)), abs=1e-4)


def test_texts_become_strings_by_bytes(spark, tmp_path):
    """Long texts in one batch of Spark's: few are held as strings at a time, all are answered in order."""
    log = tmp_path / "held"

    def load(max_tokens):
        class Model:
            def lengths(self, texts):
                with open(log, "a") as f:
                    f.write(f"{len(texts)} {sum(len(t.encode()) for t in texts)}\n")
                return [max_tokens] * len(texts)

            def __call__(self, texts):
                return np.array([[0.0, len(t) / 2_000_000] for t in texts])

        return Model()

    df = spark.range(0, 70, 1, 1).selectExpr("id", "CASE WHEN id % 10 = 3 THEN NULL ELSE repeat('\u00e4', int(id) * 10000) END AS text")
    got = score_transformer(df, "text", load).selectExpr("id", "length(text) AS n", "model.confidence AS c").collect()
    assert [r.id for r in got] == list(range(70))
    for r in got:
        assert r.c == (0.0 if not r.n else pytest.approx(1 / (1 + np.exp(-r.n / 2_000_000)), abs=1e-4))
    texts, held = np.loadtxt(log, dtype="int64").reshape(-1, 2).T
    assert texts.sum() == 62 and len(texts) > 3
    assert held.max() <= BatchScorer.BYTES


def test_text_slices_cover_all_texts_within_both_bounds():
    rng = np.random.default_rng(5)
    for sizes in (rng.integers(0, 50, 500), np.zeros(30, "int32"), np.array([999, 1, 1, 999, 999]), np.array([], "int32")):
        ranges = list(text_slices(sizes, 16, 100))
        assert [i for a, b in ranges for i in range(a, b)] == list(range(len(sizes)))
        for a, b in ranges:
            assert b - a == 1 or (b - a <= 16 and sizes[a:b].sum() <= 100)


def test_what_is_not_a_number_becomes_null(spark):
    scorer = BatchScorer("odd", lambda n: lambda texts: np.array([[np.nan, 1.0] if t == "odd" else [0.0, 1.0] for t in texts]))
    df = spark.createDataFrame([("odd",), ("x",)], "text string").coalesce(1)
    assert [(r.odd.confidence, r.odd.error) for r in score_all(df, [scorer]).collect()] == [(None, None), (0.7311, None)]
