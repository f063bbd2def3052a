"""Session settings, the shared folder, and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are tuned for.  Texts are wide, so Arrow batches are kept
# short; speculation would repeat paid model calls, so it stays off; recording a call
# site for each Column would take longer than planning the query.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.speculation": "false",
    "spark.python.worker.reuse": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def ship_with_jobs() -> None:
    """Send the package's functions along with each job, so that workers need no copy of it."""
    import mailbench

    cloudpickle.register_pickle_by_value(mailbench)


def build_session(master: str | None = None, app: str = "mailbench", **conf: str) -> SparkSession:
    """Session with the recommended settings; ``conf`` keys use ``__`` for dots."""
    ship_with_jobs()
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session, where
    one machine is the whole cluster, may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="mailbench-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/mailbench/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used before branching on anything costly (model calls, file parsing): the
    branches then read a table, lineage is cut, and a lost executor costs a re-read
    instead of a second round of calls.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Partition count for spreading rows that are few bytes but much work."""
    return max(
        spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )
