"""One query per operator over the given tables.

Every query takes ``(spark, sf_dir)`` and reads whole tables.  Map and struct results are
flattened to scalar columns so that they can be compared with SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailbench.catalog import fixtures as fx
from mailbench.functions.decisions import softmax_decide
from mailbench.functions.labels import correct, label_to_text
from mailbench.functions.replies import CORRUPT, parse_llm_json, validate_llm
from mailbench.functions.text import (
    compose_for,
    heuristic_label,
    llm_prompt_v1,
    llm_prompt_v2,
    min_length_filter,
    prefix,
)
from mailbench.operators.classify import classify_llm, classify_llm_spam
from mailbench.operators.ensemble import (
    ensemble_vote,
    long_predictions,
    models_map,
    labels_of,
    vote_sums,
)
from mailbench.operators.guards import EMPTY_RECORD, constant, empty_guard, is_empty
from mailbench.operators.journal import read_journal
from mailbench.operators.limits import head_by_class, limit_rows, sample_rows
from mailbench.operators.metrics import (
    best_model,
    confusion,
    latency_summary,
    model_metrics,
    with_summary,
)
from mailbench.operators.reshape import flatten_result
from mailbench.operators.scorers import score_all, score_native, score_transformer
from mailbench.plans import classifiers, structured
from mailbench.schemas import LLM_OUT, field_names
from mailbench.session import scratch_path
from mailbench.sinks.reports import write_json, write_report
from mailbench.sources import (
    read_class_folders,
    read_dataset,
    read_emails_json,
    read_labeled_csv,
    read_texts_json,
    split_rejects,
)
from mailbench.sources.files import list_mail_paths, read_files
from mailbench.sources.mail import class_paths, parse_mail
from mailbench.streaming import analyze_stream, read_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register under the function's name, less the underscore that avoids a clash."""
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def _file_id(path: str = "path"):
    """Document key in names such as ``…/_17.`` and ``…/17.txt``."""
    return F.regexp_extract(path, r"([0-9]+)\.[a-z]*\z", 1).cast("long")


def _metric_columns(df: DataFrame) -> DataFrame:
    return df.drop("ordinal")


# Fixture, labels, texts


@query
def labeled_emails(spark, sf_dir):
    return fx.emails(spark, sf_dir).select("*", label_to_text(F.col("label")).alias("label_text"))


@query
def compose_text(spark, sf_dir):
    df = fx.emails(spark, sf_dir)
    return df.select("email_id", compose_for(df).alias("composed"), prefix("text", 200).alias("preview"))


@query
def llm_prompt_v1_(spark, sf_dir):
    return fx.emails(spark, sf_dir).select(
        "email_id", llm_prompt_v1(F.col("subject"), F.col("text")).alias("prompt"))


@query
def llm_prompt_v2_(spark, sf_dir):
    return fx.emails(spark, sf_dir).select(
        "email_id", llm_prompt_v2(F.col("subject"), F.col("text")).alias("prompt"))


@query
def strip_then_cut(spark, sf_dir):
    """Texts wrapped in NUL and white space, so that cleaning before the cut matters."""
    framed = F.concat(F.lit(" \t\x00\n"), F.col("text"), F.lit("\n \x00 "))
    return fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("email_id"), llm_prompt_v2(F.col("source"), framed).alias("prompt"))


@query
def min_length_filter_(spark, sf_dir):
    return min_length_filter(fx.emails(spark, sf_dir)).select("email_id", F.length("text").alias("n_chars"))


@query
def heuristic_label_(spark, sf_dir):
    return fx.emails(spark, sf_dir).select("email_id", heuristic_label(F.col("text")).alias("heuristic"))


@query
def heuristic_metrics(spark, sf_dir):
    """The keyword label measured against the given one, over all e-mails."""
    said = fx.emails(spark, sf_dir).select("label", heuristic_label(F.col("text")).alias("pred"))
    return model_metrics(confusion(said, by=[]))


@query
def correct_flags(spark, sf_dir):
    scored = score_native(fx.emails(spark, sf_dir), fx.native_scorers()[1])
    truth = label_to_text(F.col("label"))
    return scored.select("email_id", truth.alias("truth"), F.col("m2.label").alias("predicted"),
                         correct(F.col("m2.label"), truth).alias("correct"))


@query
def empty_guard_(spark, sf_dir):
    """Predictions, records and errors where every fifth text is '' or null."""
    df = fx.emails(spark, sf_dir)
    df = df.select("email_id", fx.emptied(F.col("text")).alias("text"))
    scored = score_native(df, fx.native_scorers()[0])
    record = empty_guard(F.col("text"), constant({n: None for n in EMPTY_RECORD}, LLM_OUT), "record")
    scored = scored.select("*", record.alias("res"))
    return scored.select(
        "email_id",
        is_empty(F.col("text")).alias("guarded"),
        F.col("m1.label").alias("label"),
        F.col("m1.confidence").alias("confidence"),
        *[F.col(f"res.{n}").alias(f"record_{n}") for n in field_names(LLM_OUT)],
        empty_guard(F.col("text"), F.lit(None).cast("string"), "error").alias("error"),
    )


# Limits and samples


@query
def limit_first(spark, sf_dir):
    return limit_rows(fx.emails(spark, sf_dir), 20).select("email_id", "sender", "text", "label")


@query
def limit_all_but_last(spark, sf_dir):
    return limit_rows(fx.emails(spark, sf_dir), -20).select("email_id", "sender", "text", "label")


@query
def limit_none(spark, sf_dir):
    return limit_rows(fx.emails(spark, sf_dir), 0).select("email_id", "label")


@query
def sample_rows_(spark, sf_dir):
    return sample_rows(fx.emails(spark, sf_dir), 200, seed=42).select("email_id", "text", "label")


@query
def head_by_class_(spark, sf_dir):
    """100 e-mails, spam first; the key orders within a class."""
    return head_by_class(fx.emails(spark, sf_dir), 100, key="email_id").select("email_id", "text", "label")


# Scoring


@query
def softmax_decide_(spark, sf_dir):
    """Every pair of neighbouring vector components as logits of two classes."""
    vectors = fx.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    pairs = vectors.select("vec_id", F.posexplode(F.arrays_zip(
        F.col("v").alias("a"), F.slice("v", F.lit(2), F.size("v")).alias("b"))).alias("place", "pair"))
    decided = pairs.filter(F.col("pair.b").isNotNull()).select(
        "vec_id", "place", softmax_decide(F.array("pair.a", "pair.b")).alias("d"))
    return decided.select("vec_id", "place", "d.label", "d.confidence")


@query
def softmax_many_classes(spark, sf_dir):
    """Whole vectors as logits: only class 1 is spam."""
    decided = fx.table(spark, sf_dir, "embeddings").select(
        "vec_id", softmax_decide(F.col("embedding").cast("array<double>")).alias("d"))
    return decided.select("vec_id", "d.label", "d.confidence")


@query
def score_native_(spark, sf_dir):
    scored = score_native(fx.emails(spark, sf_dir), fx.native_scorers()[0])
    return scored.select("email_id", "m1.label", "m1.confidence")


@query
def score_all_long(spark, sf_dir):
    scorers = fx.native_scorers(with_noisy=True)
    scored = score_all(fx.emails(spark, sf_dir), scorers)
    return long_predictions(scored, [s.name for s in scorers], ["email_id"]).drop("error")


@query
def score_batch_udf(spark, sf_dir):
    """A Python model in Arrow batches, over raw texts."""
    scored = score_transformer(fx.emails(spark, sf_dir), "text", fx.load_word_model)
    return scored.select("email_id", "model.label", "model.confidence", "model.error")


@query
def failing_batches(spark, sf_dir):
    """A batched model that raises on some texts: those alone carry the error."""
    df = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("email_id"), "text")
    scored = score_transformer(df, "text", fx.load_failing_model)
    return scored.select("email_id", "model.label", "model.confidence", "model.error")


@query
def wrong_predictions(spark, sf_dir):
    """Details of those e-mails alone that the vote gets wrong."""
    scorers = [*fx.native_scorers()[:2], fx.batch_scorer()]
    details = classifiers.detailed_results(fx.texts(spark, sf_dir), scorers, labels=fx.labels(spark, sf_dir))
    return details.where("NOT ensemble_correct").select("email_id", "true_label", "ensemble_prediction")


@query
def score_all_documents(spark, sf_dir):
    """All documents, labelled or not, by native and batched models together."""
    documents = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("email_id"), "text")
    scorers = [*fx.native_scorers(), fx.batch_scorer()]
    scored = score_all(documents, scorers)
    return scored.select("email_id", *[
        F.col(s.name)[f].alias(f"{s.name}_{f}") for s in scorers for f in ("label", "confidence")])


# Votes


def _scored(spark, sf_dir, with_noisy: bool = False):
    scorers = fx.native_scorers(with_noisy)
    return score_all(fx.emails(spark, sf_dir), scorers), [s.name for s in scorers]


@query
def vote_counts_(spark, sf_dir):
    scored, names = _scored(spark, sf_dir, with_noisy=True)
    return vote_sums(scored, names)


@query
def ensemble_vote_(spark, sf_dir):
    """Majority of three models, and of four, where ties are possible."""
    scored, names = _scored(spark, sf_dir, with_noisy=True)
    return scored.select(
        "email_id",
        ensemble_vote(labels_of(names[:3])).alias("of_three"),
        ensemble_vote(labels_of(names)).alias("of_four"),
    )


@query
def models_map_(spark, sf_dir):
    scored, names = _scored(spark, sf_dir)
    mapped = scored.select("email_id", models_map(names, label_to_text(F.col("label"))).alias("models"))
    return mapped.select("email_id", F.explode("models").alias("model", "p")).select(
        "email_id", "model", "p.label", "p.confidence", "p.correct")


# Metrics and classifier reports


@query
def confusion_(spark, sf_dir):
    scored, names = _scored(spark, sf_dir, with_noisy=True)
    return confusion(long_predictions(scored, names, ["label"])).drop("ordinal")


@query
def model_metrics_(spark, sf_dir):
    """Metrics of three models over composed texts; the flagship query.

    Documents and labels are two tables: texts are scored before they meet the labels.
    """
    return _metric_columns(classifiers.metrics_of_label_table(
        fx.texts(spark, sf_dir), fx.labels(spark, sf_dir), fx.native_scorers()))


@query
def model_metrics_raw(spark, sf_dir):
    """The same over raw texts, with a fourth model."""
    return _metric_columns(classifiers.metrics_of_label_table(
        fx.texts(spark, sf_dir), fx.labels(spark, sf_dir), fx.native_scorers(with_noisy=True), composed=False))


@query
def model_metrics_by_source(spark, sf_dir):
    """The same per sender: groups may be many and skewed, counts are combined before the shuffle."""
    scored, names = _scored(spark, sf_dir)
    return model_metrics(confusion(long_predictions(scored, names, ["sender", "label"]), ["sender", "model"]))


@query
def best_model_(spark, sf_dir):
    return best_model(classifiers.metrics_of_label_table(
        fx.texts(spark, sf_dir), fx.labels(spark, sf_dir), fx.native_scorers(with_noisy=True), composed=False))


@query
def benchmark_report(spark, sf_dir):
    result = classifiers.benchmark(fx.texts(spark, sf_dir), fx.native_scorers(), labels=fx.labels(spark, sf_dir))
    return _metric_columns(with_summary(result.metrics))


@query
def benchmark_limited(spark, sf_dir):
    """The benchmark of the first 100 e-mails, a report on demand."""
    result = classifiers.benchmark(fx.emails(spark, sf_dir), fx.native_scorers(), limit=100)
    return _metric_columns(with_summary(result.metrics))


def _flat_details(details: DataFrame, names, key="email_id") -> DataFrame:
    return details.select(
        key, "text", "true_label", "ensemble_prediction", "ensemble_correct",
        *[F.col("models")[m][f].alias(f"{m}_{f}") for m in names for f in ("label", "confidence", "correct")],
    )


@query
def detailed_results(spark, sf_dir):
    scorers = fx.native_scorers()
    details = classifiers.detailed_results(fx.texts(spark, sf_dir), scorers, labels=fx.labels(spark, sf_dir))
    return _flat_details(details, [s.name for s in scorers])


@query
def benchmark_detailed(spark, sf_dir):
    """Details of a benchmark with a Python model among the scorers: scored once, then read."""
    scorers = [*fx.native_scorers()[:2], fx.batch_scorer()]
    result = classifiers.benchmark(
        fx.texts(spark, sf_dir), scorers, detailed=True, labels=fx.labels(spark, sf_dir))
    return _flat_details(result.details, [s.name for s in scorers])


@query
def predict_raw(spark, sf_dir):
    df = fx.emails(spark, sf_dir).select("email_id", fx.emptied(F.col("text")).alias("text"))
    scorers = fx.native_scorers()
    found = classifiers.predict(df, scorers)
    return found.select("email_id", "final_prediction", *[
        F.col("models")[s.name][f].alias(f"{s.name}_{f}") for s in scorers for f in ("label", "confidence")])


@query
def benchmark_single(spark, sf_dir):
    return _metric_columns(classifiers.benchmark_single(
        fx.texts(spark, sf_dir), fx.batch_scorer(), labels=fx.labels(spark, sf_dir)))


# Structured replies


def _planted_replies(spark, sf_dir) -> DataFrame:
    """Reply texts built from the documents' columns, most of them faulty in one way."""
    key = F.col("doc_id")
    record = F.to_json(F.struct(
        F.when(key % 16 == 1, F.repeat(F.lit("i"), 81)).otherwise(F.concat(F.lit("read "), "lang")).alias("intent"),
        (key % 3 == 0).alias("is_spam"),
        F.lit(False).alias("is_system_generated"),
        F.when(key % 16 == 2, F.repeat(F.lit("r"), 121))
        .when((key % 3 == 0) | (key % 16 == 3), F.col("source")).alias("reason"),
        F.when(key % 16 == 4, F.lit("Promo1")).when(key % 16 == 5, F.lit("a b c d"))
        .otherwise(F.lit("news")).alias("category"),
        F.when(key % 16 == 6, F.lit("urgent")).otherwise(F.lit("low")).alias("priority"),
        F.when(key % 16 == 7, F.lit(1.2)).otherwise(F.lit(0.75)).alias("confidence"),
    ), {"ignoreNullFields": "false"})
    reply = (
        F.when(key % 16 == 8, F.replace(record, F.lit('"priority"'), F.lit('"urgency"')))
        .when(key % 16 == 9, F.replace(record, F.lit('{"intent"'), F.lit('{"extra":1,"intent"')))
        .when(key % 16 == 10, F.regexp_replace(record, '"is_spam":(true|false)', '"is_spam":"yes"'))
        .when(key % 16 == 11, F.concat(F.lit("```json\n"), record, F.lit("\n```")))
        .when(key % 16 == 12, F.concat(F.lit("["), record, F.lit("]")))
        .when(key % 16 == 13, F.col("lang"))
        .when(key % 16 == 14, F.regexp_replace(record, '"intent":"[^"]*"', '"intent":5'))
        .otherwise(record)
    )
    return fx.table(spark, sf_dir, "documents").select(key.alias("email_id"), reply.alias("reply"))


@query
def parse_llm_json_(spark, sf_dir):
    parsed = parse_llm_json(_planted_replies(spark, sf_dir), out="r")
    return parsed.select("email_id", *[F.col("r")[n].alias(n) for n in field_names(LLM_OUT)],
                         F.col("r")[CORRUPT].isNotNull().alias("corrupt"))


def _violations(spark, sf_dir, rules):
    checked = validate_llm(parse_llm_json(_planted_replies(spark, sf_dir)), rules=rules)
    return checked.select("email_id", F.array_join("violations", ",").alias("violations"))


@query
def validate_llm_(spark, sf_dir):
    return _violations(spark, sf_dir, "v1")


@query
def validate_llm_v2(spark, sf_dir):
    return _violations(spark, sf_dir, "v2")


# Structured classification with the stand-in client


def _bodies(spark, sf_dir) -> DataFrame:
    return fx.emails(spark, sf_dir).withColumnRenamed("text", "body")


def _answers(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("email_id", "attempts", "error", "res.*", *extra)


@query
def llm_v1_rows(spark, sf_dir):
    return _answers(classify_llm(_bodies(spark, sf_dir), fx.StubClient, "v1"))


@query
def llm_v2_rows(spark, sf_dir):
    return _answers(classify_llm(_bodies(spark, sf_dir), fx.StubClient, "v2"), "latency_sec")


@query
def llm_v2_single_rows(spark, sf_dir):
    """One request at a time rejects e-mails without body."""
    df = classify_llm(fx.requests(spark, sf_dir), fx.StubClient, "v2", guard="error")
    return _answers(df, "latency_sec")


@query
def llm_spam_rows(spark, sf_dir):
    return _answers(classify_llm_spam(fx.emails(spark, sf_dir), fx.StubClient))


@query
def llm_bulk_v1(spark, sf_dir):
    return structured.analyze_bulk(fx.requests(spark, sf_dir), fx.StubClient, "v1").rows


@query
def llm_bulk_v2(spark, sf_dir):
    return structured.analyze_bulk(_bodies(spark, sf_dir), fx.StubClient, "v2", concurrency=5).rows


@query
def llm_bulk_v1_summary(spark, sf_dir):
    return structured.analyze_bulk(fx.requests(spark, sf_dir), fx.StubClient, "v1").summary


@query
def latency_summary_(spark, sf_dir):
    """Mean latency over all e-mails, those without a call counting as 0."""
    answered = classify_llm(fx.requests(spark, sf_dir), fx.StubClient, "v2", guard="error")
    return latency_summary(answered)


@query
def llm_calls(spark, sf_dir):
    """How the calls of a bulk analysis went: attempts, errors, broken rules."""
    calls = structured.analyze_bulk(_bodies(spark, sf_dir), fx.StubClient, "v1").calls
    return calls.select("email_id", "attempts", "error", F.size("violations").alias("n_violations"))


@query
def llm_journal(spark, sf_dir):
    """The same, run twice with a journal: the second run asks again only what failed, and the journal has every call."""
    journal = scratch_path(spark, "journal")
    for _ in range(2):
        calls = structured.analyze_bulk(_bodies(spark, sf_dir), fx.StubClient, "v1", journal=journal).calls
    entries = read_journal(spark, journal).select(F.col("key").cast("long").alias("_key"), F.col("reply").isNotNull().alias("kept"))
    return calls.join(entries, F.col("email_id") == F.col("_key"), "full").select(
        "email_id", "attempts", "error", F.size("violations").alias("n_violations"), "kept")


@query
def benchmark_llm_(spark, sf_dir):
    return structured.benchmark_llm(_bodies(spark, sf_dir), fx.StubClient, "v2").rows


@query
def benchmark_llm_summary(spark, sf_dir):
    return structured.benchmark_llm(_bodies(spark, sf_dir), fx.StubClient, "v1").summary


@query
def compare_(spark, sf_dir):
    """Side by side over all e-mails."""
    return structured.compare(fx.emails(spark, sf_dir), fx.native_scorers()[0], fx.StubClient, None).rows


@query
def compare_first(spark, sf_dir):
    """The default report: the first 20."""
    return structured.compare(fx.emails(spark, sf_dir), fx.batch_scorer("ml"), fx.StubClient, structured.COMPARED).rows


@query
def flatten_result_(spark, sf_dir):
    """The benchmark layout over the first provider's records."""
    return flatten_result(classify_llm(_bodies(spark, sf_dir), fx.StubClient, "v1"), "benchmark")


# Files


@query
def list_mail_names(spark, sf_dir):
    root = fx.render_files(fx.mail_files(spark, sf_dir), "mails")
    paths = list_mail_paths(spark, root)
    return paths.select(F.expr(f"substring(path, {len(root) + 2})").alias("name"))


@query
def parse_mail_(spark, sf_dir):
    root = fx.render_files(fx.mail_files(spark, sf_dir), "mails")
    mails = parse_mail(read_files(list_mail_paths(spark, root)))
    return mails.select(_file_id().alias("email_id"), F.col("from").alias("sender"), "subject", "text")


@query
def archive_rows(spark, sf_dir):
    """Dataset of a whole mail archive: read, length filter, keyword label."""
    root = fx.render_files(fx.mail_files(spark, sf_dir), "mails")
    mails = classifiers.archive_dataset(spark, root)
    return mails.select(_file_id().alias("email_id"), F.col("from").alias("sender"), "subject", "text", "label")


@query
def benchmark_archive(spark, sf_dir):
    root = fx.render_files(fx.mail_files(spark, sf_dir), "mails")
    result = classifiers.benchmark_archive(spark, root, fx.native_scorers(), detailed=False)
    return _metric_columns(with_summary(result.metrics))


@query
def benchmark_archive_details(spark, sf_dir):
    root = fx.render_files(fx.mail_files(spark, sf_dir), "mails")
    scorers = fx.native_scorers()
    result = classifiers.benchmark_archive(spark, root, scorers)
    keyed = result.details.withColumn("email_id", _file_id())
    return _flat_details(keyed, [s.name for s in scorers])


@query
def read_class_folders_(spark, sf_dir):
    root = fx.render_files(fx.class_files(spark, sf_dir), "classes")
    found = read_class_folders(spark, root)
    return found.select(_file_id().alias("email_id"), "subject", "body", "label")


@query
def class_folder_benchmark(spark, sf_dir):
    """Structured benchmark of a class-folder corpus, all of it."""
    root = fx.render_files(fx.class_files(spark, sf_dir), "classes")
    return structured.benchmark_class_folders(spark, root, fx.StubClient, "v1", calls_per_task=4).summary


@query
def emails_json(spark, sf_dir):
    """Requests written as JSON without null fields, read back with defaults; bodies required."""
    path = scratch_path(spark, "requests")
    case = F.col("email_id") % 7
    fx.requests(spark, sf_dir).select(
        "email_id",
        F.when(case != 3, F.col("sender")).alias("sender"),
        F.when(case != 5, F.col("subject")).alias("subject"),
        "body",
    ).write.json(path)
    accepted, rejected = split_rejects(read_emails_json(spark, path))
    return accepted.select("*", F.lit(True).alias("accepted")).unionByName(
        rejected.select("*", F.lit(False).alias("accepted")))


@query
def read_json_roundtrip(spark, sf_dir):
    """Nested per-e-mail results written as JSON and read back."""
    scorers = fx.native_scorers()
    details = classifiers.detailed_results(fx.emails(spark, sf_dir), scorers)
    path = scratch_path(spark, "details")
    write_json(details, path)
    return _flat_details(spark.read.schema(details.schema).json(path), [s.name for s in scorers])


@query
def read_csv_roundtrip(spark, sf_dir):
    """E-mails written as a CSV report and read as a labelled dataset, columns by name."""
    df = fx.emails(spark, sf_dir)
    columns = df.select("label", F.col("sender").alias("from"), "text", "subject", F.col("email_id").alias("id"))
    written = write_report(columns, scratch_path(spark, "csv"), "benchmark", "csv")
    return read_dataset(spark, "sheet", written.location, None, key="id")


@query
def read_csv_ranges(spark, sf_dir):
    """The same files, with line ends and quotes in most texts, read in ranges of 16 kB, each by a task that finds its records."""
    df = fx.emails(spark, sf_dir)
    columns = df.select("label", F.col("sender").alias("from"), "text", "subject", F.col("email_id").alias("id"))
    written = write_report(columns, scratch_path(spark, "csv"), "benchmark", "csv")
    return read_labeled_csv(spark, written.location, key="id", range_bytes=1 << 14)


@query
def read_csv_any_order(spark, sf_dir):
    """Two folders of labelled CSV with columns in different orders, read by name."""
    df = fx.emails(spark, sf_dir).select("label", F.col("sender").alias("from"), "text", "subject", F.col("email_id").alias("id"))
    orders = {0: ["id", "subject", "text", "label", "from"], 1: ["label", "text", "from", "id", "subject"]}
    written = [write_report(df.where(F.col("id") % 2 == part).select(*names), scratch_path(spark, "csv"), "benchmark", "csv").location
               for part, names in orders.items()]
    return read_labeled_csv(spark, written, key="id")


@query
def read_texts_json_(spark, sf_dir):
    """Bare texts as JSON, some without a text."""
    path = scratch_path(spark, "texts")
    fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("email_id"), F.when(F.col("doc_id") % 7 != 3, F.col("text")).alias("text")).write.json(path)
    return read_texts_json(spark, path)


@query
def report_parquet(spark, sf_dir):
    """A bulk report written as Parquet and read back, with its row count."""
    folder = scratch_path(spark, "reports")
    report = structured.analyze_bulk(fx.requests(spark, sf_dir), fx.StubClient, "v1", folder=folder)
    rows = spark.read.parquet(report.location)
    return rows.select("email_id", "sender", "intent", "is_spam", "priority", rows.agg(F.count("*").alias("n")).scalar().alias("n_rows"))


# Streams


def _stream(spark, sf_dir, score):
    source, out, state = (scratch_path(spark, n) for n in ("arrived", "scored", "state"))
    fx.requests(spark, sf_dir).drop("label").write.json(source)
    sample = score(read_emails_json(spark, source))
    for running in analyze_stream(read_stream(spark, source, max_files=4), score, out, state):
        running.awaitTermination()
    return spark.read.schema(sample.schema).parquet(out)


@query
def stream_scoring(spark, sf_dir):
    """Predictions over arriving JSON files; the content equals the batch result."""
    scorers = fx.native_scorers()
    found = _stream(spark, sf_dir, lambda df: classifiers.predict(df, scorers, "body"))
    return found.select("email_id", "final_prediction", *[
        F.col("models")[s.name][f].alias(f"{s.name}_{f}") for s in scorers for f in ("label", "confidence")])


@query
def stream_structured(spark, sf_dir):
    """Structured classification over arriving JSON files."""
    def score(df):
        return classify_llm(df, fx.StubClient, "v1", guard="record")

    return _answers(_stream(spark, sf_dir, score))
