"""Structured Streaming over a folder of JSON e-mail records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mailbench.schemas import EMAIL_IN
from mailbench.session import stage
from mailbench.sources.tables import emails_from_rows, split_rejects


def read_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """E-mails of the files in ``folder`` as they arrive, ``max_files`` per micro-batch."""
    reader = spark.readStream.schema(EMAIL_IN)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return emails_from_rows(reader.json(folder))


def analyze_stream(emails: DataFrame, score: Callable[[DataFrame], DataFrame], out: str,
                   checkpoint: str, rejects_out: str | None = None) -> list[StreamingQuery]:
    """Start scoring all e-mails available now; results go to Parquet.

    ``score`` maps accepted e-mails to results row by row, for instance a prediction or
    a structured classification.  A micro-batch that is committed is never sent to a
    model again, also after a restart from ``checkpoint``.  E-mails without a body are
    rejected; with ``rejects_out`` they are written there.

    With ``rejects_out`` one query reads the source once and writes both, each micro-batch to a folder ``batch_id=n`` of its
    own (a column when read).  A batch that was interrupted is run again with the same rows and replaces what it had
    begun; a half that it had finished stays, so that results already paid for are not asked for again.
    """
    if rejects_out is None:
        accepted, _ = split_rejects(emails)
        sink = score(accepted).writeStream.format("parquet").option("path", out)
    else:
        sink = emails.writeStream.foreachBatch(_both(score, out.rstrip("/"), rejects_out.rstrip("/")))
    state = f"{checkpoint.rstrip('/')}/{'scored' if rejects_out is None else 'both'}"
    return [sink.option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()]


def _both(score: Callable[[DataFrame], DataFrame], out: str, rejects_out: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        # Read and parsed once: both halves read this table.
        accepted, rejected = split_rejects(stage(batch, "micro-batch"))
        for rows, folder in ((score(accepted), out), (rejected, rejects_out)):
            path = f"{folder}/batch_id={number}"
            if not finished(batch.sparkSession, path):
                rows.write.mode("overwrite").parquet(path)

    return write


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a writer has ended there: Spark leaves a mark as its last step."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)
