import json

import pytest

from mailbench.functions.replies import CORRUPT, parse_llm_json, response_schema, validate_llm
from mailbench.schemas import LLM_OUT, LLM_SPAM

GOOD = {
    "intent": "ask", "is_spam": False, "is_system_generated": False, "reason": None,
    "category": "work mail", "priority": "low", "confidence": 0.5,
}
FLAGGED = {**GOOD, "is_spam": True, "reason": "advert"}
SHORT = {"is_spam": True, "category": "c", "intent": "i", "confidence": 1, "reason": "r"}


def checked(spark, reply, rules="v1", schema=LLM_OUT):
    text = reply if reply is None or isinstance(reply, str) else json.dumps(reply)
    df = spark.createDataFrame([(text,)], "reply string")
    return validate_llm(parse_llm_json(df, schema=schema), rules=rules).first()


def test_valid_record(spark):
    row = checked(spark, FLAGGED)
    record = row.record.asDict()
    assert record.pop(CORRUPT) is None
    assert record == FLAGGED and row.violations == []
    assert checked(spark, GOOD).violations == []


def test_null_reply(spark):
    row = checked(spark, None)
    assert row.record is None and row.violations is None


@pytest.mark.parametrize("reply", ["no json", "[1, 2]", json.dumps([GOOD]), f"```json\n{json.dumps(GOOD)}\n```", '"text"', "5"])
def test_not_an_object(spark, reply):
    row = checked(spark, reply)
    assert row.violations == ["not_an_object"] and row.record[CORRUPT] == reply


@pytest.mark.parametrize("change, rule", [
    ({"intent": "i" * 81}, "intent_length"),
    ({"is_spam": True, "reason": "r" * 121}, "reason_length"),
    ({"category": "Promo1"}, "category_pattern"),
    ({"category": "work\n"}, "category_pattern"),
    ({"category": "a b c d"}, "category_words"),
    ({"priority": "urgent"}, "priority"),
    ({"confidence": 1.2}, "confidence_range"),
    ({"confidence": -0.1}, "confidence_range"),
    ({"extra": 1}, "extra_key"),
    ({"is_spam": "yes"}, "wrong_type"),
    ({"intent": 5}, "wrong_type"),
    ({"confidence": "high"}, "wrong_type"),
    ({"intent": None}, "null_value"),
    ({"is_spam": True}, "reason_missing"),
    ({"reason": "why"}, "reason_unexpected"),
])
def test_one_violation_each(spark, change, rule):
    assert checked(spark, {**GOOD, **change}).violations == [rule]


@pytest.mark.parametrize("field", list(GOOD))
def test_missing_keys(spark, field):
    reply = {k: v for k, v in GOOD.items() if k != field}
    row = checked(spark, reply)
    assert row.violations == ["missing_key"] and row.record[field] is None


def test_limits_are_inclusive(spark):
    edge = {**FLAGGED, "intent": "i" * 80, "reason": "r" * 120, "category": "a" * 30, "confidence": 1}
    assert checked(spark, edge).violations == []
    assert checked(spark, {**GOOD, "category": "a" * 31}).violations == ["category_pattern"]


def test_v2_checks_less(spark):
    loose = {**GOOD, "intent": "i" * 200, "category": "Promo 1 A B C", "confidence": 7, "extra": 1}
    assert checked(spark, loose, "v2").violations == []
    assert checked(spark, {**GOOD, "priority": "urgent"}, "v2").violations == ["priority"]
    assert checked(spark, {**GOOD, "is_system_generated": True}, "v2").violations == ["reason_missing"]


def test_five_field_record(spark):
    row = checked(spark, SHORT, "spam", LLM_SPAM)
    assert row.record.confidence == 1.0 and row.violations == []
    assert checked(spark, {**SHORT, "reason": None}, "spam", LLM_SPAM).violations == ["null_value"]


def test_response_schema_has_the_record_contract():
    v1, v2, spam = (response_schema(r) for r in ("v1", "v2", "spam"))
    assert v1["required"] == v2["required"] == list(GOOD) and spam["required"] == list(SHORT)
    assert v1["additionalProperties"] is False and "additionalProperties" not in v2
    assert v1["properties"]["category"]["pattern"] == "^[a-z ]{1,30}$"
    assert v1["properties"]["confidence"] == {"type": "number", "minimum": 0, "maximum": 1}
    assert v2["properties"]["priority"]["enum"] == ["high", "medium", "low"]
    assert v2["properties"]["intent"] == {"type": "string"}
