"""Labelled CSV and JSON e-mail records."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailbench.schemas import EMAIL_IN
from mailbench.sources.records import PACKED, RANGE_BYTES, read_csv_ranges

# Environment variables that say where the dataset is.
PATH_VARIABLE = "DATA_PATH"
SHEET_VARIABLE = "DATA_URL"


def _raw_csv(spark: SparkSession, path: str, key: str | None, multi_line: bool, range_bytes: int | None) -> DataFrame:
    # No schema: Spark would bind it by position, and columns may come in any order.
    # Without column pruning every field of a row is counted, so that FAILFAST also
    # reports rows with a missing or an extra field when few columns are selected.
    # Spark takes one file's header for all; with enforceSchema off, a file with another one fails.
    raw = spark.read.option("columnPruning", False).option("enforceSchema", False).csv(
        path, header=True, multiLine=multi_line, escape='"', mode="FAILFAST"
    )
    for needed in ("text", "label"):
        if needed not in raw.columns:
            raise ValueError(f"{path}: no column {needed!r}")
    files = raw.inputFiles()
    if key is None and (not multi_line or len(files) > 1):
        raise ValueError(f"{path}: read in several parts; name the key column")
    if multi_line and range_bytes and not any(f.endswith(PACKED) for f in files):
        raw = read_csv_ranges(spark, path, raw.columns, range_bytes)
        return raw.withColumn("email_id", F.col("_number") if key is None else F.col(key).cast("long"))
    if key is not None:
        return raw.withColumn("email_id", F.col(key).cast("long"))
    # Read whole, one multi-line file is one partition, in which this is the row number.
    return raw.withColumn("email_id", F.monotonically_increasing_id())


def _labeled(raw: DataFrame, label: Column) -> DataFrame:
    def text(*names: str) -> Column:
        for name in names:
            if name in raw.columns:
                return F.col(name)
        return F.lit(None).cast("string")

    return raw.select(
        "email_id",
        text("sender", "from").alias("sender"),
        text("subject").alias("subject"),
        F.col("text"),
        label.alias("label"),
    )


def _number(label: Column) -> Column:
    """'1', '1.0' and '1.7' are 1; null if it is no number."""
    return label.try_cast("double").try_cast("int")


def read_labeled_csv(spark: SparkSession, path: str | Sequence[str], key: str | None = None,
                     strict: bool = True, multi_line: bool = True, range_bytes: int | None = RANGE_BYTES) -> DataFrame:
    """LABELED rows of CSV with a header naming ``text``, ``label``, optionally ``subject``, ``from``.

    Strict: a label other than 0 and 1 ends the job.  Otherwise rows without a numeric
    label are left out (:func:`labeled_csv_rejects` has them) and labels other than 1
    become 0.  Many files need a ``key`` column; without one there must be a
    single file, and the key is the row number, whatever number of tasks reads it.  Line ends may be quoted: a file is
    read in ranges of ``range_bytes``, each by a task of its own, after a first reading has told where records begin.
    With None, and for packed files, it is read whole by Spark, in one task; ``multi_line=False`` lets Spark split files that have no quoted line ends.

    The files of one folder must have the same header; a file that differs fails.  Several
    paths may be given, with columns in any order: each is read by its own names.
    """
    if not isinstance(path, str):
        if key is None and len(path) > 1:
            raise ValueError(f"{path}: read in several parts; name the key column")
        return reduce(DataFrame.unionByName, [read_labeled_csv(spark, p, key, strict, multi_line, range_bytes) for p in path])
    raw = _raw_csv(spark, path, key, multi_line, range_bytes)
    number = _number(F.col("label"))
    if strict:
        message = F.concat(F.lit("label is not 0 or 1: "), F.coalesce("label", F.lit("null")))
        return _labeled(raw, F.when(number.isin(0, 1), number).otherwise(
            F.raise_error(message).cast("int")))
    return _labeled(raw.filter(number.isNotNull()), F.when(number == 1, 1).otherwise(0))


def labeled_csv_rejects(spark: SparkSession, path: str, key: str | None = None,
                        multi_line: bool = True, range_bytes: int | None = RANGE_BYTES) -> DataFrame:
    """The rows a non-strict read leaves out, labels as text."""
    raw = _raw_csv(spark, path, key, multi_line, range_bytes)
    return _labeled(raw.filter(_number(F.col("label")).isNull()), F.col("label"))


def read_dataset(spark: SparkSession, source: str = "file", path: str | None = None,
                 alt_uri: str | None = None, key: str | None = None, strict: bool = True,
                 multi_line: bool = True, range_bytes: int | None = RANGE_BYTES) -> DataFrame:
    """The ``sheet`` at ``alt_uri`` if asked for and known, else the file at ``path``.

    Either defaults to what the environment of the driver names.
    """
    path = os.environ.get(PATH_VARIABLE) if path is None else path
    alt_uri = os.environ.get(SHEET_VARIABLE) if alt_uri is None else alt_uri
    where = alt_uri if source == "sheet" and alt_uri else path
    if not where:
        raise ValueError(f"no path given, and {PATH_VARIABLE} is not set")
    return read_labeled_csv(spark, where, key, strict, multi_line, range_bytes)


def emails_from_rows(df: DataFrame) -> DataFrame:
    """EMAIL_IN columns with subject and sender defaulting to ''.

    A nested column ``emails`` (array of records) becomes one row per record; its rows
    need a ``request_id``, and the key of a record is that with its place in the array.
    """
    if "emails" in df.columns:
        df = df.select("request_id", F.posexplode("emails").alias("place", "e")).select(
            F.concat_ws(":", "request_id", "place").alias("email_id"), "e.sender", "e.subject", "e.body"
        )

    def optional(name: str) -> Column:
        value = F.col(name) if name in df.columns else F.lit(None)
        return F.coalesce(value, F.lit("")).alias(name)

    return df.select("email_id", optional("sender"), optional("subject"), "body")


def read_emails_json(spark: SparkSession, path: str, key: str | None = "email_id", text_keys: bool = False) -> DataFrame:
    """E-mail records, one JSON object per line, with defaults filled in.

    ``key`` names the field that identifies a record, a number or, with ``text_keys``, any text;
    a record without it ends the job.  With None the key is the file, the part of it and the row
    in that part, which stays the same as long as the files and the split size do.
    """
    fields = ", ".join(f for f in EMAIL_IN.split(", ") if not f.startswith("email_id"))
    if key is None:
        raw = spark.read.schema(fields).json(path)
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        return emails_from_rows(raw.withColumn(
            "email_id", F.concat_ws(":", "_metadata.file_path", "_metadata.file_block_start", row)))
    raw = spark.read.schema(f"{fields}, `{key}` {'string' if text_keys else 'long'}").json(path)
    missing = F.raise_error(F.lit(f"e-mail record without {key}")).cast("string" if text_keys else "long")
    return emails_from_rows(raw.withColumn("email_id", F.coalesce(F.col(key), missing)))


def read_texts_json(spark: SparkSession, path: str) -> DataFrame:
    """Bare texts to predict, one JSON object with ``text`` per line; a missing text is ''."""
    raw = spark.read.schema("email_id long, text string").json(path)
    return raw.select("email_id", F.coalesce("text", F.lit("")).alias("text"))


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E-mails with a body, and those that lack the required body."""
    return df.filter(F.col("body").isNotNull()), df.filter(F.col("body").isNull())
