"""The e-mails in the given tables, stand-in models and clients, and rendered files.

Pretrained models and language-model providers are not reachable from a test, so the
registered queries use the stand-ins below.  Their rules are simple enough for SQL.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailbench.operators.classify import Request
from mailbench.operators.scorers import BatchScorer, NativeScorer
from mailbench.session import parallelism, scratch_path
from mailbench.sources.files import Stores

WORDS = {
    "m1": ("trash", "clown", "scum", "idiot"),
    "m2": ("worthless", "moron", "pathetic", "loser"),
    "m3": ("disgusting", "stupid", "idiot", "trash"),
}
BIAS = {"m1": -1.0, "m2": -0.5, "m3": -0.75}
PER_WORD = {"m1": 2.0, "m2": 1.25, "m3": 1.5}
LONG_OVER = 3000


def native_scorers(with_noisy: bool = False) -> list[NativeScorer]:
    """Three word-list scorers, and one that calls long texts spam."""
    found = [NativeScorer(m, WORDS[m], PER_WORD[m], BIAS[m]) for m in WORDS]
    if with_noisy:
        found.append(NativeScorer("m4", bias=-1.5, if_long=3.0, long_over=LONG_OVER))
    return found


def load_word_model(max_tokens: int):
    """Batched stand-in: two logits from the number of m1 and m2 words in the text."""
    words = WORDS["m1"] + WORDS["m2"]

    def model(texts: list[str]) -> np.ndarray:
        lowered = [text.lower() for text in texts]
        hits = np.array([sum(word in text for word in words) for text in lowered], dtype="float64")
        return np.column_stack([np.full(len(texts), 0.5), 1.75 * hits - 0.25])

    return model


def load_failing_model(max_tokens: int):
    """The same, but it raises for any batch with a text that speaks of a clown."""
    model = load_word_model(max_tokens)

    def scored(texts: list[str]) -> np.ndarray:
        if any("clown" in text.lower() for text in texts):
            raise RuntimeError("no clowns")
        return model(texts)

    return scored


def batch_scorer(name: str = "batched") -> BatchScorer:
    return BatchScorer(name, load_word_model)


class StubClient:
    """A provider that answers by rule, fails for some keys, and keeps its own time.

    Of every 50 keys, 7 never gets JSON, 13 always fails, 11 fails once.
    """

    SEND_SEC = 0.25

    def __init__(self):
        self.now = 0.0

    def clock(self) -> float:
        return self.now

    def sleep(self, seconds: float) -> None:
        self.now += seconds

    def send(self, request: Request) -> str | dict:
        self.now += self.SEND_SEC
        # Keys that are paths of the class-folder corpus end in the number.
        number = request.key if isinstance(request.key, int) else int(request.key.rpartition("/")[2].partition(".")[0])
        case = number % 50
        if case == 13:
            raise RuntimeError("provider unavailable")
        if case == 11 and request.attempt == 1:
            raise RuntimeError("provider busy")
        if case == 7:
            return "this is not JSON"
        spam = any(w in request.prompt.lower() for w in WORDS["m2"])
        system = len(request.prompt) > LONG_OVER
        record = {
            "intent": "insult" if spam else "inform",
            "is_spam": spam,
            "is_system_generated": system,
            "reason": "abusive words" if spam else "long text" if system else None,
            "category": "abuse" if spam else "general notice",
            "priority": "low" if spam or system else "medium",
            "confidence": 0.9 if spam else 0.6,
        }
        if "priority" not in request.schema["properties"]:
            record = {name: record[name] for name in ("is_spam", "category", "intent", "confidence")}
            record["reason"] = "abusive words" if spam else "no abusive words"
        return record if number % 2 else json.dumps(record)


# The given tables that hold what e-mails are made of.
TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as e-mails without a label."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("email_id"),
        F.col("source").alias("sender"),
        F.substring_index("text", "\n", 1).alias("subject"),
        "text",
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity as the spam label."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("email_id"), F.col("toxic").alias("label")
    )


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LABELED e-mails: the documents that have a label."""
    return texts(spark, sf_dir).join(labels(spark, sf_dir), "email_id")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMAIL_IN records of the same e-mails; every tenth body is '', another tenth null."""
    return emails(spark, sf_dir).select(
        "email_id", "sender", "subject", emptied(F.col("text")).alias("body"), "label"
    )


def emptied(text: Column) -> Column:
    case = F.col("email_id") % 10
    return F.when(case == 4, F.lit("")).when(case == 9, F.lit(None)).otherwise(text)


PART = "=_part_of_mail_"


def mail_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name, content`` of one mail per document, of five kinds by id.

    Plain text; HTML only; HTML and text parts; HTML part only; no From and Subject.
    Names and folders include some that start with ``_`` and ``.``.
    """
    text, key = F.col("text"), F.col("doc_id")
    head = F.concat(
        F.lit("From: "), F.col("source"), F.lit("@example.org\nSubject: Document "),
        key.cast("string"), F.lit("\nMIME-Version: 1.0\n"),
    )
    plain = F.concat(
        F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), text
    )
    html = F.concat(
        F.lit("Content-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n<p>"),
        text, F.lit("</p>"),
    )
    mixed = F.lit(f'Content-Type: multipart/alternative; boundary="{PART}"\n\n')
    part, end = F.lit(f"--{PART}\n"), F.lit(f"\n--{PART}--\n")
    kind = key % 5
    content = (
        F.when(kind == 0, F.concat(head, plain))
        .when(kind == 1, F.concat(head, html))
        .when(kind == 2, F.concat(head, mixed, part, html, F.lit("\n"), part, plain, end))
        .when(kind == 3, F.concat(head, mixed, part, html, end))
        .otherwise(F.concat(F.lit("X-Kind: bare\n\n"), text))
    )
    folder = F.when(key % 3 == 0, "_sent_mail").when(key % 3 == 1, ".inbox/old").otherwise("all")
    name = F.concat_ws("/", F.col("source"), folder, F.concat(F.lit("_"), key.cast("string"), F.lit(".")))
    return table(spark, sf_dir, "documents").select(name.alias("name"), content.alias("content"))


def class_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name, content`` of one text per e-mail under ``spam/`` or ``ham/``, with CR LF line ends."""
    folder = F.when(F.col("label") == 1, "spam/").otherwise("ham/")
    return emails(spark, sf_dir).select(
        F.concat(folder, F.col("email_id").cast("string"), F.lit(".txt")).alias("name"),
        F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("content"),
    )


def render_files(files: DataFrame, name: str) -> str:
    """Write one file per row below a new shared folder, in tasks; returns the folder.

    A repeated task writes the same files again.
    """
    spark = files.sparkSession
    root = scratch_path(spark, name)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stores = Stores()
        for batch in batches:
            for relative, content in zip(batch["name"], batch["content"]):
                stores.write(f"{root}/{relative}", content.encode("utf-8"))
            yield batch[["name"]]

    spread = files.repartition(parallelism(spark))
    spread.mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()
    return root
