"""The call journal: what ended is never asked again."""

import json
import os
import subprocess
import sys
import textwrap
from collections import Counter
from pathlib import Path

import pytest
from pyarrow import fs

from mailbench.catalog.fixtures import StubClient
from mailbench.operators.classify import classify_llm
from mailbench.operators.journal import Journal, bucket_of, call_id, read_journal
from mailbench.plans import structured
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent


class Counted(StubClient):
    """Writes down each attempt; the folder says where."""

    def __init__(self, log):
        super().__init__()
        self.log = log

    def send(self, request):
        with open(self.log, "ab", buffering=0) as f:
            f.write(f"{request.key} {request.attempt}\n".encode())
        return super().send(request)


def counted(log):
    return lambda: Counted(str(log))


def sent(log):
    return Counter(line.split()[0] for line in log.read_text().splitlines()) if log.exists() else Counter()


def mails(spark, n=60):
    return spark.range(n).selectExpr("id AS email_id", "'s' AS sender", "concat('subject ', id) AS subject",
                                     "IF(id % 9 = 4, NULL, concat('body of ', id)) AS body").repartition(3)


def answers(df):
    rows = df.select("email_id", "reply", "attempts", "error", "res").collect()
    return {r["email_id"]: (json.loads(r["reply"]) if r["reply"] else None, *r[2:]) for r in rows}


@pytest.mark.parametrize("calls_per_task", [1, 4])
def test_same_answers_and_no_second_call(spark, tmp_path, calls_per_task):
    journal, log = str(tmp_path / "journal"), tmp_path / "log"
    plain = answers(classify_llm(mails(spark), StubClient, "v1"))
    first = answers(classify_llm(mails(spark), counted(log), "v1", journal=journal, calls_per_task=calls_per_task))
    assert first == plain and len(sent(log)) == 60
    before = sent(log)
    again = answers(classify_llm(mails(spark), counted(log), "v1", journal=journal, concurrency=2))
    more = sent(log) - before
    # Keys 7, 13, 57 of every 50 fail for good and are asked again by a new run; nothing else is.
    assert again == plain and set(more) == {str(k) for k in range(60) if k % 50 in (7, 13)}


def test_other_questions_are_other_calls(spark, tmp_path):
    journal, log = str(tmp_path / "journal"), tmp_path / "log"
    df = mails(spark, 5)
    answers(classify_llm(df, counted(log), "v1", journal=journal))
    answers(classify_llm(df, counted(log), "v2", journal=journal))
    changed = df.withColumn("body", F.concat("body", F.lit("!")))
    answers(classify_llm(changed, counted(log), "v1", journal=journal))
    assert sent(log) == {"0": 3, "1": 3, "2": 3, "3": 3, "4": 2}  # 4 has no body to change


def test_equal_calls_and_guarded_rows(spark, tmp_path):
    log = tmp_path / "log"
    df = spark.createDataFrame([(1, "s", "same")] * 50 + [(2, "s", None), (None, "s", "no key")], "email_id long, subject string, body string")
    text_keys = df.withColumn("email_id", F.coalesce(F.col("email_id").cast("string"), F.lit("0")))
    got = classify_llm(text_keys, counted(log), "v1", guard="record", journal=str(tmp_path / "journal")).collect()
    assert len(got) == 52 and sent(log) == {"1": 1, "0": 1}
    assert {r["attempts"] for r in got} == {0, 1}


def test_identity_tells_null_from_text(spark):
    df = spark.createDataFrame([(None, "p"), ("-", "p"), ("=", "p"), ("a", None)], "key string, prompt string")
    ids = [r[0] for r in df.select(call_id(df.key, df.prompt, "v1")).collect()]
    assert len(set(ids)) == 4 and ids[3] is None
    assert df.select(bucket_of(call_id(df.key, df.prompt, "v1"))).where("key IS NULL").first()[0] in range(1024)


def outcome(reply="{}", error=None):
    return {"reply": reply, "attempts": 1, "error": error, "latency_sec": 0.5}


def test_torn_lines(spark, tmp_path):
    """A part that ends in the middle of a line gives its whole lines."""
    one = Journal(str(tmp_path), "run")
    one.enter({3})
    one.add(3, "a", 1, outcome('{"x": 1}'))
    one.add(3, "b", 2, outcome('{"x": 2}'))
    one.close()
    (part,) = (tmp_path / "bucket=3").iterdir()
    part.write_bytes(part.read_bytes()[:-10])
    two = Journal(str(tmp_path), "other run")
    two.enter({3})
    assert two.known(3, "a") == outcome('{"x": 1}') and two.known(3, "b") is None
    two.add(3, "b", 2, outcome('{"x": 3}'))
    two.close()
    found = {r["id"]: r["reply"] for r in read_journal(spark, str(tmp_path)).collect()}
    assert found == {"a": '{"x": 1}', "b": '{"x": 3}'}


def test_failures_count_within_their_run_only(spark, tmp_path):
    one = Journal(str(tmp_path), "run")
    one.enter({1, 2})
    one.add(1, "a", 1, outcome(None, "busy"))
    one.close()
    for run, found in (("run", outcome(None, "busy")), ("next", None)):
        other = Journal(str(tmp_path), run)
        other.enter({1})
        assert other.known(1, "a") == found
    other.add(1, "a", 1, outcome("{}"))
    other.close()
    assert [(r["reply"], r["error"]) for r in read_journal(spark, str(tmp_path)).collect()] == [("{}", None)]


def test_stores_without_append(tmp_path, monkeypatch):
    """Parts of a few calls, each a file of its own; leaving a bucket does not lose what waits."""
    journal = Journal(str(tmp_path), "run", part_calls=3)
    journal.appends = False
    journal.enter({1, 2})
    for i in range(8):
        journal.add(1 + i % 2, f"c{i}", i, outcome())
    kept = Journal(str(tmp_path), "run")
    kept.enter({1, 2})
    assert sum(len(a) for a in kept.answers.values()) == 6  # two wait
    journal.enter({5})
    journal.close()
    kept = Journal(str(tmp_path), "run")
    kept.enter({1, 2})
    assert sum(len(a) for a in kept.answers.values()) == 8


KILLED = '''
    import os, sys
    sys.path[:0] = [{root!r}, {tests!r}]
    os.environ["PYTHONPATH"] = {root!r} + os.pathsep + {tests!r}
    from mailbench.session import build_session
    from mailbench.plans.structured import analyze_bulk
    from test_journal import Counted

    class Dying(Counted):
        """Kills its worker process at the 9th call of a task, twice in all."""
        made = 0
        def send(self, request):
            Dying.made += 1
            if Dying.made == 9:
                for mark in ("one", "two"):
                    try:
                        os.close(os.open({folder!r} + "/" + mark, os.O_CREAT | os.O_EXCL))
                    except FileExistsError:
                        continue
                    os._exit(9)
            return super().send(request)

    spark = build_session("local[2,4]", "killed", spark__ui__enabled="false", spark__sql__shuffle__partitions="2",
                          spark__checkpoint__dir={folder!r} + "/shared", spark__log__level="ERROR")
    df = spark.range(80).selectExpr("id AS email_id", "'s' AS sender", "'t' AS subject", "concat('body ', id) AS body")
    report = analyze_bulk(df, lambda: Dying({folder!r} + "/log"), "v1", concurrency=2, journal={folder!r} + "/journal")
    assert report.rows.count() == 80
    print("rows", report.summary.first()[0])
'''


def test_a_killed_worker_repeats_no_finished_call(tmp_path):
    """Two worker processes die in the middle of their partition; every call is made as often as without that."""
    script = textwrap.dedent(KILLED).format(root=str(ROOT), tests=str(ROOT / "tests"), folder=str(tmp_path))
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=240)
    assert "rows 80" in done.stdout, done.stderr[-3000:]
    assert (tmp_path / "one").exists() and (tmp_path / "two").exists()
    want = {str(k): 3 if k % 50 in (7, 13) else 2 if k % 50 == 11 else 1 for k in range(80)}
    assert sent(tmp_path / "log") == want


def test_reports_with_a_journal(spark, tmp_path):
    journal, log = str(tmp_path / "journal"), tmp_path / "log"
    df = mails(spark, 20)
    one = structured.analyze_bulk(df, counted(log), "v2", concurrency=3, journal=journal)
    two = structured.analyze_bulk(df, counted(log), "v2", journal=journal)
    assert sorted(one.rows.collect(), key=str) == sorted(two.rows.collect(), key=str)
    assert set((sent(log) - Counter({str(k): 1 for k in range(20)})).keys()) <= {"7", "13", "11"}
    labelled = df.withColumn("label", F.lit(1))
    scored = structured.benchmark_llm(labelled, counted(log), "v2", journal=journal)
    assert scored.summary.first()["total_samples"] == 20
    assert sent(log)["3"] == 1  # the benchmark asks the same questions


def test_remote_parts_are_read_back(tmp_path):
    """Through a file system that is given by URI, where the journal writes whole parts."""
    journal = Journal(f"file://{tmp_path}", "run")
    assert journal.appends  # a mounted path
    store, _ = fs.FileSystem.from_uri(f"file://{tmp_path}")
    journal.stores.locate = lambda path: (store, path.removeprefix("file://"))
    journal.appends, journal.part_calls = False, 1
    journal.enter({9})
    journal.add(9, "x", "k", outcome())
    journal.enter(set())
    journal.enter({9})
    assert journal.known(9, "x") == outcome()
    assert os.listdir(tmp_path) == ["bucket=9"]
