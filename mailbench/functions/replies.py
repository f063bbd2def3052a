"""Typing and checking the JSON records language models reply with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailbench.schemas import LLM_OUT, LLM_SPAM, field_names

# Limits of the seven-field record.
MAX_INTENT = 80
MAX_REASON = 120
MAX_CATEGORY_WORDS = 3
CATEGORY_PATTERN = r"^[a-z ]{1,30}\z"
PRIORITIES = ("high", "medium", "low")

CORRUPT = "_corrupt_record"

JSON_TYPES = {"string": "string", "boolean": "boolean", "double": "number"}


def response_schema(rules: str = "v1") -> dict:
    """JSON schema of the record, for providers that can be held to one.

    It says what :func:`validate_llm` checks by the same ``rules``, as far as a schema can.
    """
    ddl = LLM_SPAM if rules == "spam" else LLM_OUT
    properties = {}
    for part in ddl.split(","):
        name, kind = part.split()
        properties[name] = {"type": JSON_TYPES[kind]}
    schema = {"type": "object", "required": list(properties), "properties": properties}
    if rules != "spam":
        properties["reason"]["type"] = ["string", "null"]
        properties["priority"]["enum"] = list(PRIORITIES)
    if rules == "v1":
        properties["intent"]["maxLength"] = MAX_INTENT
        properties["reason"]["maxLength"] = MAX_REASON
        properties["category"]["pattern"] = CATEGORY_PATTERN.replace(r"\z", "$")
        properties["confidence"].update(minimum=0, maximum=1)
        schema["additionalProperties"] = False
    return schema


def _kind(document: Column, field: str) -> Column:
    """JSON type of one field as Spark names it; null if the field is absent."""
    return F.schema_of_variant(F.try_variant_get(document, f"$.{field}", "variant"))


def parse_llm_json(df: DataFrame, reply: str = "reply", out: str = "record",
                   schema: str = LLM_OUT) -> DataFrame:
    """``df`` with reply texts typed as struct ``out``.

    A text that does not fit the schema is kept in the field ``_corrupt_record``.
    ``from_json`` turns numbers into strings for string fields without complaint, so
    those fields are checked against the type they have in the document.  Each reply is
    parsed in a column of its own, which the fields below refer to.
    """
    parsed = df.select(
        "*",
        F.from_json(reply, f"{schema}, {CORRUPT} string",
                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("_typed"),
        F.try_parse_json(reply).alias("_document"),
    )
    mistyped = F.lit(False)
    fields = []
    for part in schema.split(","):
        name, kind = part.split()
        value = F.col("_typed")[name]
        if kind == "string":
            found = _kind(F.col("_document"), name)
            wrong = F.coalesce(~found.isin("STRING", "VOID"), F.lit(False))
            value = F.when(~wrong, value)
            mistyped = mistyped | wrong
        fields.append(value.alias(name))
    corrupt = F.when(mistyped, F.col(reply)).otherwise(F.col("_typed")[CORRUPT])
    record = F.when(F.col(reply).isNotNull(), F.struct(*fields, corrupt.alias(CORRUPT)))
    return parsed.select("*", record.alias(out)).drop("_typed", "_document")


def validate_llm(df: DataFrame, reply: str = "reply", record: str = "record",
                 out: str = "violations", rules: str = "v1") -> DataFrame:
    """``df`` with the rules each reply breaks as ``array<string>`` ``out``; null for a null reply.

    ``v1`` checks the whole record contract, ``v2`` keys, types, the priority values
    and a reason for flagged mail, ``spam`` keys and types of the five-field record.
    """
    required = field_names(LLM_SPAM if rules == "spam" else LLM_OUT)
    nullable = set() if rules == "spam" else {"reason"}
    keyed = df.select("*", F.json_object_keys(reply).alias("_keys"))
    keys, fields = F.col("_keys"), F.col(record)
    wanted = F.array(*[F.lit(name) for name in required])
    corrupt = fields[CORRUPT].isNotNull()

    some_null = F.lit(False)
    for name in required:
        if name not in nullable:
            some_null = some_null | (F.array_contains(keys, name) & fields[name].isNull())

    checks = [
        ("missing_key", F.size(F.array_except(wanted, keys)) > 0),
        ("wrong_type", corrupt),
        ("null_value", ~corrupt & some_null),
    ]
    if rules in ("v1", "v2"):
        flagged = fields["is_spam"] | fields["is_system_generated"]
        checks += [
            ("priority", ~fields["priority"].isin(*PRIORITIES)),
            ("reason_missing", ~corrupt & flagged & fields["reason"].isNull()
             & F.array_contains(keys, "reason")),
        ]
    if rules == "v1":
        words = F.size(F.split(F.trim(fields["category"]), " +"))
        checks += [
            ("extra_key", F.size(F.array_except(keys, wanted)) > 0),
            ("intent_length", F.length(fields["intent"]) > MAX_INTENT),
            ("reason_length", F.length(fields["reason"]) > MAX_REASON),
            ("reason_unexpected", ~flagged & fields["reason"].isNotNull()),
            ("category_pattern", ~fields["category"].rlike(CATEGORY_PATTERN)),
            ("category_words", words > MAX_CATEGORY_WORDS),
            ("confidence_range", ~fields["confidence"].between(0, 1)),
        ]
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))
    found = F.when(keys.isNotNull(), broken).otherwise(F.array(F.lit("not_an_object")))
    return keyed.select("*", F.when(F.col(reply).isNotNull(), found).alias(out)).drop("_keys")
