"""A journal of paid calls: written as each call ends, read before one is made.

Every call has an identity, the digest of what is sent.  Identities are dealt to a fixed number of buckets, a bucket is
a folder, and a bucket's calls are made by one task.  Each task attempt writes parts of its own there, one JSON
object per line, and never touches those of others; it first reads what earlier attempts and earlier runs
left.  So a task that dies half-way, on whatever machine it is tried again, repeats no call that had ended.
"""

from __future__ import annotations

import hashlib
import json
import os
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailbench.sources.files import PASSED_OVER, Stores, attempted

BUCKETS = 1024
PART_CALLS = 16  # calls per part where a file cannot be appended to

OUTCOME = ("reply", "attempts", "error", "latency_sec")
ENTRY = "id string, key string, run string, reply string, attempts int, error string, latency_sec double"


def call_id(key: Column, prompt: Column, asked: str) -> Column:
    """Digest of key, prompt and ``asked``, whatever else determines the answer; null for a null prompt."""
    digest = hashlib.sha256(asked.encode()).hexdigest()
    known_key = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("-"))
    return F.sha2(F.concat(F.lit(digest), F.sha2(known_key, 256), F.sha2(prompt, 256)), 256)


def bucket_of(identity: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of a call; calls that are not made, which have no identity, are in none."""
    return (F.conv(F.substring(identity, 1, 8), 16, 10).cast("long") % buckets).cast("int")


class Journal:
    """One task's view: the buckets it is in, what is known there, and the parts it writes."""

    def __init__(self, folder: str, run: str, part_calls: int = PART_CALLS):
        self.folder, self.run, self.part_calls = folder.rstrip("/"), run, part_calls
        self.stores, self.lock = Stores(), threading.Lock()
        self.appends = self.stores.locate(self.folder)[0] is None
        self.attempt, self.written = uuid.uuid4().hex, 0
        self.answers: dict[int, dict[str, dict]] = {}  # bucket -> identity -> outcome
        self.waiting: dict[int, list[str]] = {}

    def _path(self, bucket: int) -> str:
        return f"{self.folder}/bucket={bucket}"

    def enter(self, buckets: set[int]) -> None:
        """Be in these buckets alone.  New ones are read, complete lines only: a part may end in the middle of one."""
        for left in self.answers.keys() - buckets:
            del self.answers[left]
        for bucket in buckets - self.answers.keys():
            self.answers[bucket] = {}
            for path, is_folder in sorted(self.stores.readable(self._path(bucket))):
                if not is_folder and path.endswith(".jsonl"):
                    self._read(path, self.answers[bucket])

    def _read(self, path: str, answers: dict[str, dict]) -> None:
        try:
            content = attempted(lambda: self.stores.read(path))
        except PASSED_OVER:
            return
        for line in content.split(b"\n")[:-1]:
            try:
                entry = json.loads(line)
                identity, outcome = entry["id"], {name: entry[name] for name in OUTCOME}
            except (ValueError, KeyError, TypeError):
                continue
            # What failed in an earlier run is asked again; in this run it had its attempts.
            if outcome["error"] is None or entry["run"] == self.run and identity not in answers:
                answers[identity] = outcome

    def known(self, bucket: int, identity: str) -> dict | None:
        with self.lock:
            return self.answers[bucket].get(identity)

    def add(self, bucket: int, identity: str, key, outcome: dict) -> None:
        """Keep the outcome of a call that has ended, before anything is done with it."""
        line = json.dumps({"id": identity, "key": None if key is None else str(key), "run": self.run, **outcome})
        with self.lock:
            self.answers[bucket][identity] = {name: outcome[name] for name in OUTCOME}
            self.waiting.setdefault(bucket, []).append(line + "\n")
            if self.appends or sum(map(len, self.waiting.values())) >= self.part_calls:
                self._write()

    def _write(self) -> None:
        for bucket, lines in self.waiting.items():
            content = "".join(lines).encode()
            if self.appends:
                inside = self.stores.locate(self._path(bucket))[1]
                os.makedirs(inside, exist_ok=True)
                with open(f"{inside}/{self.attempt}.jsonl", "ab", buffering=0) as part:
                    part.write(content)
                    os.fsync(part.fileno())
            else:
                path = f"{self._path(bucket)}/{self.attempt}-{self.written:06d}.jsonl"
                attempted(lambda: self.stores.write(path, content))
            self.written += 1
        self.waiting = {}

    def close(self) -> None:
        with self.lock:
            self._write()


def read_journal(spark: SparkSession, folder: str) -> DataFrame:
    """``id, key, run, reply, attempts, error, latency_sec`` of every call in a journal, one row per identity.

    Of several outcomes of one call a success comes before a failure.  Torn lines are passed over.
    """
    entries = spark.read.schema(f"{ENTRY}, _torn string").option("columnNameOfCorruptRecord", "_torn").json(f"{folder.rstrip('/')}/*/*.jsonl")
    first = Window.partitionBy("id").orderBy(F.col("error").isNotNull(), "run", F.col("reply"))
    whole = entries.where("_torn IS NULL AND id IS NOT NULL AND attempts IS NOT NULL").drop("_torn")
    return whole.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
