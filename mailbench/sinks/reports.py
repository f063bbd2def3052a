"""Reports: a folder per run, named after kind and time, which is there whole or not at all.

A report is written under a name that no reader looks at, gets a manifest with its kind and row count, and is then given its
name.  Where renaming a folder is one step (file systems), the report appears with that; on object stores, where it is not,
the manifest is written anew as the last step, and :func:`read_report` takes no folder without one.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Kinds of report and the time stamp in their names.
KINDS = ("email_analysis", "bulk", "benchmark")
STAMP = "%Y%m%d_%H%M%S"
MANIFEST = "_manifest.json"


class Written(NamedTuple):
    location: str
    rows: int


def write_report(df: DataFrame, folder: str, kind: str, fmt: str = "parquet",
                 now: datetime | None = None, order_by: str | None = None) -> Written:
    """Write ``df`` to ``folder/kind_time`` as Parquet, or as CSV with a header.

    The rows are counted while they are written.  A report of the same second is not
    overwritten.  ``order_by`` restores the order of the input across the files.  What a job that failed has written stays under
    ``folder/_unfinished``, which readers pass over, and may be deleted.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind of report: {kind}")
    location = f"{folder.rstrip('/')}/{kind}_{(now or datetime.now()).strftime(STAMP)}"
    store = _Folders(df.sparkSession, location)
    if store.exists(location):
        raise _taken(location)
    counted = Observation()
    ordered = df if order_by is None else df.orderBy(order_by)
    unnamed = f"{folder.rstrip('/')}/_unfinished/{uuid.uuid4().hex}"
    writer = ordered.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists")
    if fmt == "csv":
        writer.csv(
            unnamed, header=True, escape='"', quoteAll=True,
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
    elif fmt == "parquet":
        writer.parquet(unnamed)
    else:
        raise ValueError(f"unknown format: {fmt}")
    rows = counted.get["rows"]
    manifest = json.dumps({"kind": kind, "format": fmt, "rows": rows, "columns": df.columns})
    if store.renames_at_once:
        store.write(f"{unnamed}/{MANIFEST}", manifest)
    store.rename(unnamed, location)
    if not store.renames_at_once:
        store.write(f"{location}/{MANIFEST}", manifest)
    return Written(location, rows)


def _taken(location: str) -> AnalysisException:
    """The error of Spark's own writers."""
    return AnalysisException(f"[PATH_ALREADY_EXISTS] Path {location} already exists.")


class _Folders:
    """The file system of a path, as Spark's own writers see it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.store = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.renames_at_once = self.store.getUri().getScheme() in ("file", "hdfs", "viewfs")

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.store.exists(self._path(path))

    def rename(self, old: str, new: str) -> None:
        """Another report of that name may have come in between: it stays, and this one has no name."""
        if self.exists(new) or not self.store.rename(self._path(old), self._path(new)):
            raise _taken(new)

    def write(self, path: str, text: str) -> None:
        out = self.store.create(self._path(path), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        source = self.store.open(self._path(path))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()


def manifest_of(spark: SparkSession, location: str) -> dict:
    """Kind, format, rows and columns of a finished report; an error for anything else."""
    store, path = _Folders(spark, location), f"{location.rstrip('/')}/{MANIFEST}"
    if not store.exists(path):
        raise FileNotFoundError(f"{location}: no finished report")
    return json.loads(store.read(path))


def read_report(spark: SparkSession, location: str) -> DataFrame:
    """The rows of a finished report; CSV columns are texts."""
    manifest = manifest_of(spark, location)
    if manifest["format"] == "parquet":
        return spark.read.parquet(location)
    columns = ", ".join(f"`{c}` string" for c in manifest["columns"])
    return spark.read.schema(columns).csv(location, header=True, multiLine=True, escape='"', mode="FAILFAST")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; maps and structs stay nested, nulls are written."""
    df.write.mode("errorifexists").json(path, ignoreNullFields=False)
