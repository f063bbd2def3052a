"""Structured classification by a language model reached through a client.

The client is supplied by the caller: ``open_client()`` runs once per partition, inside
the task, and is where keys are read from the executor's environment.  It returns an
object with

* ``send(request) -> str | dict``: the reply, as JSON text or as a parsed object;
* optionally ``clock() -> float`` and ``sleep(seconds)``, by default those of ``time``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailbench.functions.replies import parse_llm_json, response_schema, validate_llm
from mailbench.functions.text import PROMPT_V1_CHARS, llm_prompt_v1, llm_prompt_v2, prefix
from mailbench.operators.guards import EMPTY_RECORD, constant, empty_guard, is_empty
from mailbench.operators.journal import BUCKETS, PART_CALLS, Journal, bucket_of, call_id
from mailbench.schemas import LLM_OUT, LLM_SPAM, field_names
from mailbench.session import parallelism

CALL = "reply string, attempts int, error string, latency_sec double"

INSTRUCTION = """\
Classify one e-mail. Read its subject and body and nothing else, and do not guess at
facts they do not state. If it has several purposes, report the main one. Answer with
one JSON object and no other text. Its seven keys are:

intent (string): what the e-mail wants, in a short phrase of at most 80 characters.
is_spam (boolean): true for advertising, phishing, unsolicited or irrelevant bulk mail.
is_system_generated (boolean): true for automatic and no-reply mail.
reason (string or null): if either flag is true, why, in at most 120 characters; else null.
category (string): one to three lower-case words.
priority (string): "high" if urgent or blocking, "medium" if there is a problem to solve,
  "low" if it informs, is spam or was generated by a system.
confidence (number from 0 to 1): from 0.8 if the purpose is clear, 0.5 to 0.8 if it is
  ambiguous, below 0.5 if the text is noisy or says too little.
"""

SPAM_INSTRUCTION = """\
You detect spam. For the e-mail given, answer with one JSON object with the keys is_spam
(boolean), category (string), intent (string), confidence (number from 0 to 1) and reason
(string).
"""

# What an e-mail gets whose calls all failed; the reason is the error text.
ERROR_RECORD = {
    "intent": "error",
    "is_spam": False,
    "is_system_generated": False,
    "reason": None,
    "category": "error",
    "priority": "low",
    "confidence": 0.0,
}
UNKNOWN_RECORD = {
    "is_spam": False,
    "category": "unknown",
    "intent": "unknown",
    "confidence": 0.0,
    "reason": None,
}


@dataclass(frozen=True)
class Request:
    """What a client is asked to send."""

    key: Any
    attempt: int
    prompt: str
    instruction: str
    schema: dict
    temperature: float | None
    timeout_sec: float | None


@dataclass(frozen=True)
class Variant:
    """One way of asking: prompt, record, attempts and fallback."""

    rules: str
    prompt: Callable[[Column, Column], Column]
    instruction: str
    fields: str
    fallback: dict = field(hash=False)
    attempts: int = 3
    pause_sec: float = 1.0
    temperature: float | None = 0
    timeout_sec: float | None = None
    error_prefix: str = ""
    with_latency: bool = False


# Attempts, pause, timeout, temperature and error prefix of each variant.
VARIANTS = {
    "v1": Variant("v1", llm_prompt_v1, INSTRUCTION, LLM_OUT, ERROR_RECORD, timeout_sec=30),
    "v2": Variant("v2", llm_prompt_v2, INSTRUCTION, LLM_OUT, ERROR_RECORD,
                  error_prefix="LLM Error: ", with_latency=True),
    "spam": Variant("spam", lambda subject, body: prefix(body, PROMPT_V1_CHARS), SPAM_INSTRUCTION,
                    LLM_SPAM, UNKNOWN_RECORD, attempts=1, temperature=None),
}


def _ask(client, variant: Variant, key, prompt: str) -> dict:
    """Send until a JSON object comes back or the attempts are used up."""
    clock = getattr(client, "clock", time.monotonic)
    sleep = getattr(client, "sleep", time.sleep)
    start = clock()
    outcome = {"reply": None, "attempts": 0, "error": None}
    while outcome["reply"] is None and outcome["attempts"] < variant.attempts:
        if outcome["attempts"]:
            sleep(variant.pause_sec)
        outcome["attempts"] += 1
        try:
            reply = client.send(Request(
                key, outcome["attempts"], prompt, variant.instruction, response_schema(variant.rules),
                variant.temperature, variant.timeout_sec,
            ))
            if isinstance(reply, dict):
                reply = json.dumps(reply)
            if not isinstance(json.loads(reply), dict):
                raise ValueError("reply is not a JSON object")
            outcome.update(reply=reply, error=None)
        except Exception as problem:
            outcome["error"] = variant.error_prefix + str(problem)
    outcome["latency_sec"] = round(clock() - start, 3)
    return outcome


UNASKED = {"reply": None, "attempts": 0, "error": None, "latency_sec": None}


def _journaled_column(open_client: Callable[[], Any], variant: Variant, key: Column, prompt: Column, whole: bool,
                      calls_per_task: int, identity: Column, folder: str, part_calls: int) -> Column:
    """:func:`_call_column` with a journal between rows and client.

    A call that the journal knows is not made, and equal calls of a batch are made once.  Rows come in the order of their
    buckets, so that a batch is in few buckets when buckets are large.
    """
    run = uuid.uuid4().hex  # made on the driver: all attempts of all tasks of this column share it

    def calls(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        client, journal = open_client(), Journal(folder, run, part_calls)

        def ask(call):
            identity, bucket, key, prompt = call
            outcome = journal.known(bucket, identity)
            if outcome is None:
                outcome = _ask(client, variant, int(key) if whole and key is not None else key, prompt)
                journal.add(bucket, identity, key, outcome)
            return identity, outcome

        pool = ThreadPoolExecutor(calls_per_task) if calls_per_task > 1 else None
        try:
            for keys, prompts, identities, buckets in batches:
                made = {i: (i, int(b), k, p) for k, p, i, b in zip(keys, prompts, identities, buckets) if p is not None}
                journal.enter({bucket for _, bucket, _, _ in made.values()})
                answers = dict((pool.map if pool else map)(ask, made.values()))
                outcomes = [UNASKED if p is None else answers[i] for i, p in zip(identities, prompts)]
                yield pd.DataFrame(outcomes, columns=["reply", "attempts", "error", "latency_sec"])
        finally:
            journal.close()
            if pool:
                pool.shutdown()

    return F.pandas_udf(calls, CALL).asNondeterministic()(key.cast("string"), prompt, identity, bucket_of(identity))


def _call_column(open_client: Callable[[], Any], variant: Variant, key: Column, prompt: Column,
                 whole: bool, calls_per_task: int) -> Column:
    """Call outcome as a column; a null prompt is not sent.

    Keys travel as text, since a null among numbers would make floats of all; ``whole`` ones are numbers
    again for the client.  ``calls_per_task`` calls are in flight at a time, by one client, in a batch's order.
    Only key and prompt go to Python.  The function is marked nondeterministic so that
    no plan rewrite duplicates it or moves a filter across it.
    """

    def calls(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        client = open_client()
        for keys, prompts in batches:
            def ask(key, prompt):
                if prompt is None:
                    return UNASKED
                return _ask(client, variant, int(key) if whole and key is not None else key, prompt)

            if calls_per_task == 1:
                rows = [ask(*pair) for pair in zip(keys, prompts)]
            else:
                with ThreadPoolExecutor(calls_per_task) as pool:
                    rows = list(pool.map(ask, keys, prompts))
            yield pd.DataFrame(rows, columns=["reply", "attempts", "error", "latency_sec"])

    return F.pandas_udf(calls, CALL).asNondeterministic()(key.cast("string"), prompt)


def _asked(variant: Variant) -> str:
    """What, beside key and prompt, an answer depends on."""
    return json.dumps([variant.rules, variant.instruction, response_schema(variant.rules), variant.attempts, variant.temperature])


def _dealt(df: DataFrame, identity: Column, concurrency: int | None) -> tuple[DataFrame, Column]:
    """Rows with all calls of a bucket in one task, in the order of buckets; what is not called is spread by its own hash."""
    bucket = bucket_of(identity)
    own = F.coalesce(bucket, F.pmod(F.xxhash64(*df.columns), F.lit(BUCKETS)).cast("int"))
    dealt = df.repartition(concurrency or parallelism(df.sparkSession), own).sortWithinPartitions(bucket)
    return dealt, identity


def classify_llm(df: DataFrame, open_client: Callable[[], Any], variant: str = "v1",
                 guard: str | None = None, subject: str = "subject", body: str = "body",
                 key: str = "email_id", calls_per_task: int = 1, journal: str | None = None,
                 concurrency: int | None = None, part_calls: int = PART_CALLS) -> DataFrame:
    """``df`` with the record ``res`` of each e-mail and how it was come by.

    Adds reply, attempts, error, violations of the record's rules, res, and latency_sec
    where the variant reports it.  A record with violations is reported as it came.
    With a ``guard``, e-mails without body are not sent: ``'record'`` gives them the
    empty record, ``'error'`` a null record and an error.  The result costs calls: stage
    it before using it more than once.  A task has ``calls_per_task`` calls in flight, so a client
    must stand being used from as many threads.

    With a ``journal``, a folder that all executors share, each call that has ended is kept there and never made
    again, neither by a task that is tried again nor by a later run over the same e-mails; calls that failed are asked again by
    later runs.  Rows are then dealt by the bucket of their call, to ``concurrency`` tasks if given, and equal calls
    are made once.  Where files cannot be appended to (object stores), ``part_calls`` calls are kept at a time, and a task that
    dies repeats those of one part at most.
    """
    if calls_per_task < 1 or part_calls < 1:
        raise ValueError("calls_per_task and part_calls must be positive")
    how = VARIANTS[variant]
    subject_text = F.coalesce(F.col(subject), F.lit("")) if subject in df.columns else F.lit("")
    body_text = F.coalesce(F.col(body), F.lit(""))
    prompt = how.prompt(subject_text, body_text)
    empty = is_empty(F.col(body))
    if guard:
        prompt = F.when(~empty, prompt)

    whole = isinstance(df.schema[key].dataType, T.IntegralType)
    if journal is None:
        call = _call_column(open_client, how, F.col(key), prompt, whole, calls_per_task)
    else:
        df, identity = _dealt(df, call_id(F.col(key), prompt, _asked(how)), concurrency)
        call = _journaled_column(open_client, how, F.col(key), prompt, whole, calls_per_task, identity, journal, part_calls)
    asked = df.select("*", call.alias("call"))
    answered = asked.select("*", F.col("call.reply").alias("reply"))
    typed = validate_llm(parse_llm_json(answered, out="typed", schema=how.fields),
                         record="typed", rules=how.rules)

    names = field_names(how.fields)
    fallback = constant({**how.fallback, "reason": ""}, how.fields)
    record = F.struct(*[F.col("typed")[name].alias(name) for name in names])
    failed = F.struct(*[
        (F.col("call.error") if name == "reason" else fallback[name]).alias(name) for name in names
    ])
    res = F.when(F.col("call.error").isNotNull(), failed).otherwise(record)
    error = F.col("call.error")
    if guard == "record":
        res = F.when(empty, constant(EMPTY_RECORD, how.fields)).otherwise(res)
    elif guard == "error":
        res = F.when(~empty, res)
        error = empty_guard(F.col(body), error, "error")
    latency = [F.col("call.latency_sec").alias("latency_sec")] if how.with_latency else []
    return typed.select(
        *df.columns,
        "reply",
        F.col("call.attempts").alias("attempts"),
        error.alias("error"),
        "violations",
        res.alias("res"),
        *latency,
    )


def classify_llm_spam(df: DataFrame, open_client: Callable[[], Any], text: str = "text",
                      key: str = "email_id", calls_per_task: int = 1, **journaling) -> DataFrame:
    """Five-field classification of the bare text, one attempt; ``journaling`` as in :func:`classify_llm`."""
    return classify_llm(df, open_client, "spam", body=text, key=key, calls_per_task=calls_per_task, **journaling)


def with_concurrency(df: DataFrame, n: int = 5) -> DataFrame:
    """At most ``n`` tasks that call; with ``calls_per_task`` calls each."""
    return df.repartition(n)
