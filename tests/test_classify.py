import json
import threading
import time

import pytest

from mailbench.operators.classify import VARIANTS, classify_llm, classify_llm_spam, with_concurrency
from mailbench.operators.guards import EMPTY_RECORD

RECORD = {
    "intent": "ask", "is_spam": True, "is_system_generated": False, "reason": "why",
    "category": "work", "priority": "high", "confidence": 0.8,
}
SHORT = {"is_spam": True, "category": "c", "intent": "i", "confidence": 0.7, "reason": "r"}


class Script:
    """A client that follows a script: per attempt a reply, or an exception to raise."""

    def __init__(self, *steps, log=None):
        self.steps, self.log, self.now = steps, log, 0.0

    def send(self, request):
        self.now += 0.5
        if self.log:
            with open(self.log, "a") as f:
                f.write(json.dumps([request.key, request.attempt, request.prompt, request.temperature,
                                    request.timeout_sec]) + "\n")
        step = self.steps[request.attempt - 1]
        if isinstance(step, Exception):
            raise step
        return step

    def clock(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


@pytest.fixture
def mail(spark):
    return spark.createDataFrame([(1, "hello", "body")], "email_id long, subject string, body string")


def calls(log):
    return [json.loads(line) for line in log.read_text().splitlines()]


def test_first_reply(mail, tmp_path):
    log = tmp_path / "calls"
    row = classify_llm(mail, lambda: Script(json.dumps(RECORD), log=str(log)), "v1").first()
    assert row.res.asDict() == RECORD and (row.attempts, row.error) == (1, None)
    assert calls(log) == [[1, 1, "\nEmail Subject: hello\nEmail Body: body\n", 0, 30]]


def test_second_attempt(mail):
    row = classify_llm(mail, lambda: Script(RuntimeError("busy"), RECORD), "v1").first()
    assert row.res.asDict() == RECORD and (row.attempts, row.error) == (2, None)


@pytest.mark.parametrize("steps, reason", [
    ([RuntimeError("one"), RuntimeError("two"), RuntimeError("three")], "three"),
    (["no", "no", "no"], "Expecting value: line 1 column 1 (char 0)"),
    (["[]", "5", '"x"'], "reply is not a JSON object"),
])
@pytest.mark.parametrize("variant, prefix", [("v1", ""), ("v2", "LLM Error: ")])
def test_fallback_after_three(mail, tmp_path, steps, reason, variant, prefix):
    log = tmp_path / "calls"
    row = classify_llm(mail, lambda: Script(*steps, log=str(log)), variant).first()
    assert row.res.asDict() == {
        "intent": "error", "is_spam": False, "is_system_generated": False, "reason": prefix + reason,
        "category": "error", "priority": "low", "confidence": 0.0,
    }
    assert row.attempts == len(calls(log)) == 3 and row.error == prefix + reason


def test_latency_covers_attempts_and_pauses(mail):
    fails = RuntimeError("busy")
    row = classify_llm(mail, lambda: Script(fails, fails, RECORD), "v2").first()
    assert row.latency_sec == 3 * 0.5 + 2 * 1.0
    row = classify_llm(mail, lambda: Script(fails, fails, fails), "v2").first()
    assert row.latency_sec == 3.5
    assert "latency_sec" not in classify_llm(mail, lambda: Script(RECORD), "v1").columns


def test_five_fields_one_attempt(spark, tmp_path):
    log = tmp_path / "calls"
    df = spark.createDataFrame([(1, "t" * 4000)], "email_id long, text string")
    row = classify_llm_spam(df, lambda: Script(RuntimeError("down"), log=str(log))).first()
    assert row.res.asDict() == {
        "is_spam": False, "category": "unknown", "intent": "unknown", "confidence": 0.0, "reason": "down"}
    assert [c[2] for c in calls(log)] == ["t" * 3000]
    assert classify_llm_spam(df, lambda: Script(SHORT)).first().res.asDict() == SHORT


def test_guards_do_not_call(spark, tmp_path):
    log = tmp_path / "calls"
    rows = [(1, "s", ""), (2, "s", None), (3, "s", " "), (4, "s", "x")]
    df = spark.createDataFrame(rows, "email_id long, subject string, body string")
    got = {r.email_id: r for r in classify_llm(df, lambda: Script(RECORD, log=str(log)), "v1", "record").collect()}
    assert sorted(c[0] for c in calls(log)) == [3, 4]
    assert got[1].res.asDict() == got[2].res.asDict() == EMPTY_RECORD
    assert got[3].res.asDict() == RECORD
    got = {r.email_id: r for r in classify_llm(df, lambda: Script(RECORD), "v2", "error").collect()}
    assert got[1].res is None and got[1].error == "Email body is required" and got[4].error is None


def test_without_a_guard_empty_bodies_are_sent(spark):
    df = spark.createDataFrame([(1, "s", None)], "email_id long, subject string, body string")
    assert classify_llm(df, lambda: Script(RECORD), "v2").first().attempts == 1


def test_one_call_per_row_even_if_fields_and_filters_follow(mail, tmp_path):
    log = tmp_path / "calls"
    df = classify_llm(mail, lambda: Script(RECORD, log=str(log)), "v1")
    df.select("res.intent", "res.is_spam", "attempts").filter("is_spam AND attempts = 1").collect()
    assert len(calls(log)) == 1


def test_concurrency_bounds_partitions(spark):
    df = spark.range(100, numPartitions=20)
    assert with_concurrency(df).rdd.getNumPartitions() == 5


def test_instruction_names_every_key():
    for name in ("v1", "v2"):
        for key in RECORD:
            assert key in VARIANTS[name].instruction


def test_broken_rules_are_reported_with_the_record(mail):
    row = classify_llm(mail, lambda: Script({**RECORD, "priority": "urgent", "category": "No"}), "v1").first()
    assert row.violations == ["priority", "category_pattern"] and row.res.priority == "urgent"
    assert classify_llm(mail, lambda: Script(RECORD), "v1").first().violations == []
    assert classify_llm(mail, lambda: Script("no", "no", "no"), "v1").first().violations is None


def test_wrong_types_become_null(mail):
    row = classify_llm(mail, lambda: Script({**RECORD, "is_spam": "yes", "intent": 3}), "v1").first()
    assert row.res.is_spam is None and row.res.intent is None and row.res.category == "work"
    assert row.violations == ["wrong_type"]


class Overlapping:
    """Counts how many calls are under way at once."""

    def __init__(self):
        self.lock, self.now, self.most = threading.Lock(), 0, 0

    def send(self, request):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
        time.sleep(0.05)
        with self.lock:
            self.now -= 1
        return {"is_spam": False, "category": str(self.most), "intent": repr(request.key), "confidence": 0.5, "reason": None}


def test_calls_in_flight_and_intact_keys(spark):
    keys = [9007199254740993, None, *range(10)]
    df = spark.createDataFrame([(k, f"t{k}") for k in keys], "email_id long, text string").coalesce(1)
    for width in (1, 4):
        rows = classify_llm_spam(df, Overlapping, calls_per_task=width).collect()
        assert [r.email_id for r in rows] == keys and [r.res.intent for r in rows] == [repr(k) for k in keys]
        assert max(int(r.res.category) for r in rows) == width
    with pytest.raises(ValueError):
        classify_llm_spam(df, Overlapping, calls_per_task=0)
