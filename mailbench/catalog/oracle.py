"""SQL with the results of the registered queries, for an independent engine."""

from __future__ import annotations

from mailbench.catalog.fixtures import BIAS, LONG_OVER, PER_WORD, WORDS
from mailbench.functions.text import SPAM_WORDS

EMAILS = """emails AS (
  SELECT d.doc_id AS email_id, d.source AS sender, split_part(d.text, chr(10), 1) AS subject,
         d.text AS text, l.toxic AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

EMPTIED = "CASE WHEN email_id % 10 = 4 THEN '' WHEN email_id % 10 = 9 THEN NULL ELSE text END"

REQUESTS = f"{EMAILS}, requests AS (SELECT email_id, sender, subject, {EMPTIED} AS body, label FROM emails)"


def composed(sender: str = "sender") -> str:
    return (
        f"chr(10) || '    From: ' || substring({sender}, 1, 100)"
        " || chr(10) || '    Subject: ' || substring(subject, 1, 200)"
        " || chr(10) || '    Body: ' || substring(text, 1, 1000) || chr(10) || '    '"
    )


COMPOSED = f"{EMAILS}, texts AS (SELECT email_id, label, {composed()} AS text FROM emails)"


def text_label(flag: str) -> str:
    return f"CASE WHEN {flag} THEN 'spam' ELSE 'not spam' END"


def hits(model: str, text: str = "text") -> str:
    return " + ".join(f"contains(lower({text}), '{w}')::INT" for w in WORDS[model])


def any_word(words, text: str = "text") -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def logit(model: str) -> str:
    """Spam logit over a column ``text``; the other logit is 0."""
    if model == "m4":
        return f"(-1.5::DOUBLE + 3.0 * (length(text) > {LONG_OVER})::INT)"
    return f"({BIAS[model]}::DOUBLE + {PER_WORD[model]}::DOUBLE * ({hits(model)}))"


def confidence(z: str) -> str:
    top = f"greatest({z}, 0.0::DOUBLE)"
    return f"round_even(1.0 / (exp(0.0::DOUBLE - {top}) + exp({z} - {top})), 4)"


def scored(source: str, models: list[str], keep: str = "email_id, text, label") -> str:
    """CTEs ending in ``scored``: ``<m>_z``, ``<m>_label``, ``<m>_confidence`` per model."""
    zs = ", ".join(f"{logit(m)} AS {m}_z" for m in models)
    out = ", ".join(
        f"{text_label(f'{m}_z > 0')} AS {m}_label, {confidence(f'{m}_z')} AS {m}_confidence" for m in models
    )
    return (
        f"logits AS (SELECT {keep}, {zs} FROM {source}), "
        f"scored AS (SELECT *, {out} FROM logits)"
    )


def long_form(models: list[str], keep: str) -> str:
    return "long AS (" + " UNION ALL ".join(
        f"SELECT {keep}, '{m}' AS model, {i} AS ordinal, {m}_label AS predicted, "
        f"{m}_confidence AS confidence, ({m}_z > 0)::INT AS pred FROM scored"
        for i, m in enumerate(models)
    ) + ")"


COUNTS = (
    "count(*) AS n, count(*) FILTER (pred = 1 AND label = 1) AS tp, "
    "count(*) FILTER (pred = 1 AND label = 0) AS fp, "
    "count(*) FILTER (pred = 0 AND label = 1) AS fn, "
    "count(*) FILTER (pred = 0 AND label = 0) AS tn"
)


def ratio(part: str, whole: str) -> str:
    return f"round_even(CASE WHEN {whole} = 0 THEN 0.0 ELSE ({part})::DOUBLE / ({whole}) END, 4)"


METRICS = (
    f"round_even((tp + tn)::DOUBLE / n, 4) AS accuracy, {ratio('tp', 'tp + fp')} AS precision, "
    f"{ratio('tp', 'tp + fn')} AS recall, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1"
)

M3 = ["m1", "m2", "m3"]
M4 = [*M3, "m4"]
VOTE3 = "(m1_z > 0)::INT + (m2_z > 0)::INT + (m3_z > 0)::INT"
LONG3 = f"{scored('texts', M3)}, {long_form(M3, 'label')}, counts AS (SELECT model, {COUNTS} FROM long GROUP BY model)"


def details(models: list[str], vote: str, key: str = "email_id") -> str:
    truth = text_label("label = 1")
    columns = ", ".join(
        f"{m}_label, {m}_confidence, {m}_label = {truth} AS {m}_correct" for m in models
    )
    said = text_label(vote)
    return (
        f"SELECT {key}, text, {truth} AS true_label, {said} AS ensemble_prediction, "
        f"{said} = {truth} AS ensemble_correct, {columns} FROM scored"
    )


# The batched stand-in model: logits 0.5 and 1.75 * hits - 0.25.
BATCH_HITS = f"({hits('m1')} + {hits('m2')})"
BATCH_Z = f"(1.75::DOUBLE * {BATCH_HITS} - 0.25 - 0.5)"


def prompt(variant: str, body: str = "text") -> str:
    body = f"coalesce({body}, '')"
    if variant == "v1":
        return (f"chr(10) || 'Email Subject: ' || subject || chr(10) || 'Email Body: ' "
                f"|| substring({body}, 1, 3000) || chr(10)")
    if variant == "v2":
        return f"'Subject: ' || subject || chr(10) || chr(10) || 'Body:' || chr(10) || substring({body}, 1, 6000)"
    return f"substring({body}, 1, 3000)"


NOT_JSON = "Expecting value: line 1 column 1 (char 0)"


def answered(variant: str, source: str = "emails", body: str = "text", guard: str = "FALSE",
             keep: str = "email_id, sender, subject, label") -> str:
    """CTEs ending in ``answered``: the stand-in client's records with attempts and error."""
    attempts = 1 if variant == "spam" else 3
    error_prefix = "LLM Error: " if variant == "v2" else ""
    fails = "email_id % 50 IN (7, 13)" if attempts > 1 else "email_id % 50 IN (7, 11, 13)"
    fallback = "unknown" if variant == "spam" else "error"
    spam = any_word(WORDS["m2"], "prompt")
    return f"""asked AS (
  SELECT {keep}, {body} AS body, {prompt(variant, body)} AS prompt, {guard} AS guarded FROM {source}),
judged AS (
  SELECT *, NOT guarded AND {fails} AS failed, {spam} AS spam, length(prompt) > {LONG_OVER} AS long FROM asked),
answered AS (
  SELECT {keep}, body, guarded, failed,
    CASE WHEN guarded THEN 0 WHEN failed THEN {attempts} WHEN email_id % 50 = 11 THEN 2 ELSE 1 END::INT AS attempts,
    CASE WHEN failed THEN '{error_prefix}' || CASE email_id % 50 WHEN 7 THEN '{NOT_JSON}'
      WHEN 13 THEN 'provider unavailable' ELSE 'provider busy' END END AS error,
    CASE WHEN failed THEN '{fallback}' WHEN spam THEN 'insult' ELSE 'inform' END AS intent,
    CASE WHEN failed THEN FALSE ELSE spam END AS is_spam,
    CASE WHEN failed THEN FALSE ELSE long END AS is_system_generated,
    CASE WHEN spam THEN 'abusive words' WHEN long THEN 'long text' END AS why,
    CASE WHEN failed THEN '{fallback}' WHEN spam THEN 'abuse' ELSE 'general notice' END AS category,
    CASE WHEN failed OR spam OR long THEN 'low' ELSE 'medium' END AS priority,
    CASE WHEN failed THEN 0.0 WHEN spam THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence,
    CASE WHEN guarded THEN NULL WHEN failed THEN 2.75 WHEN email_id % 50 = 11 THEN 1.5 ELSE 0.25 END::DOUBLE
      AS latency_sec
  FROM judged)"""


REASON = "CASE WHEN failed THEN error ELSE why END AS reason"
RECORD = f"intent, is_spam, is_system_generated, {REASON}, category, priority, confidence"
# The record of an e-mail without body, where it is guarded.
GUARDED = (
    "CASE WHEN guarded THEN 'empty' ELSE intent END AS intent, "
    "NOT guarded AND is_spam AS is_spam, "
    "NOT guarded AND is_system_generated AS is_system_generated, "
    "CASE WHEN guarded THEN 'empty body' WHEN failed THEN error ELSE why END AS reason, "
    "CASE WHEN guarded THEN 'none' ELSE category END AS category, "
    "CASE WHEN guarded THEN 'low' ELSE priority END AS priority, "
    "CASE WHEN guarded THEN 0.0::DOUBLE ELSE confidence END AS confidence"
)
REJECTED = ", ".join(
    f"CASE WHEN guarded THEN NULL ELSE {n} END AS {n}"
    for n in ("intent", "is_spam", "is_system_generated", "category", "priority", "confidence")
) + ", CASE WHEN guarded THEN NULL WHEN failed THEN error ELSE why END AS reason"
NO_BODY = "coalesce(body, '') = ''"
SPAM_REASON = "CASE WHEN failed THEN error WHEN is_spam THEN 'abusive words' ELSE 'no abusive words' END"

MAILS = """mails AS (
  SELECT doc_id AS email_id,
    CASE WHEN doc_id % 5 = 4 THEN '' ELSE source || '@example.org' END AS sender,
    CASE WHEN doc_id % 5 = 4 THEN '' ELSE 'Document ' || doc_id END AS subject,
    CASE doc_id % 5 WHEN 1 THEN '<p>' || text || '</p>' WHEN 3 THEN '' ELSE text END AS text
  FROM documents)"""
ARCHIVE = (
    f"{MAILS}, archive AS (SELECT *, {any_word(SPAM_WORDS)}::INT AS label FROM mails WHERE length(text) > 20), "
    f"texts AS (SELECT email_id, label, {composed()} AS text FROM archive)"
)

# Reply texts with planted faults, and their fields looked up as JSON.
REPLIES = """base AS (
  SELECT doc_id AS email_id, doc_id % 16 AS fault, lang,
    '{"intent":"' || CASE WHEN doc_id % 16 = 1 THEN repeat('i', 81) ELSE 'read ' || lang END
    || '","is_spam":' || CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END
    || ',"is_system_generated":false,"reason":'
    || CASE WHEN doc_id % 16 = 2 THEN '"' || repeat('r', 121) || '"'
            WHEN doc_id % 3 = 0 OR doc_id % 16 = 3 THEN '"' || source || '"' ELSE 'null' END
    || ',"category":"' || CASE doc_id % 16 WHEN 4 THEN 'Promo1' WHEN 5 THEN 'a b c d' ELSE 'news' END
    || '","priority":"' || CASE doc_id % 16 WHEN 6 THEN 'urgent' ELSE 'low' END
    || '","confidence":' || CASE doc_id % 16 WHEN 7 THEN '1.2' ELSE '0.75' END || '}' AS record
  FROM documents),
replies AS (
  SELECT email_id, CASE fault
    WHEN 8 THEN replace(record, '"priority"', '"urgency"')
    WHEN 9 THEN replace(record, '{"intent"', '{"extra":1,"intent"')
    WHEN 10 THEN regexp_replace(record, '"is_spam":(true|false)', '"is_spam":"yes"')
    WHEN 11 THEN '```json' || chr(10) || record || chr(10) || '```'
    WHEN 12 THEN '[' || record || ']'
    WHEN 13 THEN lang
    WHEN 14 THEN regexp_replace(record, '"intent":"[^"]*"', '"intent":5')
    ELSE record END AS reply
  FROM base),
docs AS (
  SELECT email_id, reply, json_valid(reply) AND reply LIKE '{%' AS is_object,
    CASE WHEN json_valid(reply) AND reply LIKE '{%' THEN reply ELSE '{}' END AS doc
  FROM replies),
parsed AS (
  SELECT *, json_keys(doc) AS keys,
    CASE WHEN json_type(doc, '$.intent') = 'VARCHAR' THEN doc ->> '$.intent' END AS intent,
    CASE WHEN json_type(doc, '$.is_spam') = 'BOOLEAN' THEN (doc ->> '$.is_spam')::BOOLEAN END AS is_spam,
    CASE WHEN json_type(doc, '$.is_system_generated') = 'BOOLEAN'
      THEN (doc ->> '$.is_system_generated')::BOOLEAN END AS is_system_generated,
    CASE WHEN json_type(doc, '$.reason') = 'VARCHAR' THEN doc ->> '$.reason' END AS reason,
    CASE WHEN json_type(doc, '$.category') = 'VARCHAR' THEN doc ->> '$.category' END AS category,
    CASE WHEN json_type(doc, '$.priority') = 'VARCHAR' THEN doc ->> '$.priority' END AS priority,
    CASE WHEN json_type(doc, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT')
      THEN (doc ->> '$.confidence')::DOUBLE END AS confidence,
    coalesce(json_type(doc, '$.intent') NOT IN ('VARCHAR', 'NULL'), FALSE)
      OR coalesce(json_type(doc, '$.is_spam') NOT IN ('BOOLEAN', 'NULL'), FALSE)
      OR coalesce(json_type(doc, '$.confidence') NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT', 'NULL'), FALSE) AS mistyped
  FROM docs)"""

FIELDS = ("intent", "is_spam", "is_system_generated", "reason", "category", "priority", "confidence")
WANTED = "[" + ", ".join(f"'{f}'" for f in FIELDS) + "]"
FLAGGED = "(is_spam OR is_system_generated)"


def violations(rules: str) -> str:
    checks = [
        ("missing_key", f"NOT list_has_all(keys, {WANTED})"),
        ("wrong_type", "mistyped"),
        ("priority", "priority NOT IN ('high', 'medium', 'low')"),
        ("reason_missing", f"NOT mistyped AND {FLAGGED} AND reason IS NULL AND list_contains(keys, 'reason')"),
    ]
    if rules == "v1":
        checks += [
            ("extra_key", f"NOT list_has_all({WANTED}, keys)"),
            ("intent_length", "length(intent) > 80"),
            ("reason_length", "length(reason) > 120"),
            ("reason_unexpected", f"NOT {FLAGGED} AND reason IS NOT NULL"),
            ("category_pattern", "NOT regexp_full_match(category, '[a-z ]{1,30}')"),
            ("category_words", "len(string_split(category, ' ')) > 3"),
            ("confidence_range", "NOT confidence BETWEEN 0 AND 1"),
        ]
    cases = ", ".join(f"CASE WHEN {bad} THEN '{name}' END" for name, bad in checks)
    return (
        f"WITH {REPLIES} SELECT email_id, CASE WHEN is_object THEN concat_ws(',', {cases}) "
        "ELSE 'not_an_object' END AS violations FROM parsed"
    )


def predictions(source: str) -> str:
    """Vote and model columns over ``source(email_id, text)``, empty texts guarded."""
    models = ", ".join(
        f"CASE WHEN empty THEN 'not spam' ELSE {m}_label END AS {m}_label, "
        f"CASE WHEN empty THEN 0.0::DOUBLE ELSE {m}_confidence END AS {m}_confidence" for m in M3
    )
    keep = "email_id, text, coalesce(text, '') = '' AS empty"
    return (
        f"{scored(source, M3, keep)} SELECT email_id, {text_label(f'NOT empty AND ({VOTE3}) * 2 > 3')} AS final_prediction, {models} FROM scored"
    )


def bulk_v1() -> str:
    return (
        f"WITH {REQUESTS}, {answered('v1', 'requests', 'body', NO_BODY)} SELECT email_id, sender, subject, "
        f"substring(coalesce(body, ''), 1, 200) AS body, {GUARDED} FROM answered"
    )


def llm_benchmark(latency: str) -> str:
    return (
        "SELECT email_id, substring(body, 1, 200) AS body, label AS actual, is_spam::INT AS predicted, "
        f"is_spam::INT = label AS correct, {RECORD}{latency} FROM answered"
    )


def comparison(model_z: str, limit: str = "") -> str:
    truth, said = text_label("label = 1"), text_label("is_spam")
    ml = text_label("z > 0")
    return (
        f"WITH {EMAILS}, chosen AS (SELECT *, {model_z} AS z FROM emails {limit}), "
        f"{answered('spam', 'chosen', keep='email_id, label, z')} "
        f"SELECT email_id, body AS text, {truth} AS true_label, {ml} AS ml_prediction, {ml} = {truth} AS ml_correct, "
        f"{said} AS llm_prediction, {said} = {truth} AS llm_correct, category AS llm_category, intent AS llm_intent, "
        f"confidence AS llm_confidence, {SPAM_REASON} AS llm_reason FROM answered"
    )


def oracle() -> dict[str, str]:
    sql = {}

    sql["labeled_emails"] = f"WITH {EMAILS} SELECT *, {text_label('label = 1')} AS label_text FROM emails"
    sql["compose_text"] = (
        f"WITH {EMAILS} SELECT email_id, {composed()} AS composed, substring(text, 1, 200) AS preview FROM emails"
    )
    for v in ("v1", "v2"):
        sql[f"llm_prompt_{v}"] = f"WITH {EMAILS} SELECT email_id, {prompt(v)} AS prompt FROM emails"
    sql["strip_then_cut"] = (
        "SELECT doc_id AS email_id, 'Subject: ' || source || chr(10) || chr(10) || 'Body:' || chr(10) "
        "|| substring(text, 1, 6000) AS prompt FROM documents"
    )
    sql["min_length_filter"] = (
        f"WITH {EMAILS} SELECT email_id, length(text)::INT AS n_chars FROM emails WHERE length(text) > 20"
    )
    sql["heuristic_label"] = f"WITH {EMAILS} SELECT email_id, {any_word(SPAM_WORDS)}::INT AS heuristic FROM emails"
    sql["heuristic_metrics"] = (
        f"WITH {EMAILS}, said AS (SELECT label, {any_word(SPAM_WORDS)}::INT AS pred FROM emails), "
        f"counts AS (SELECT {COUNTS} FROM said) SELECT *, {METRICS} FROM counts"
    )
    sql["correct_flags"] = (
        f"WITH {EMAILS}, {scored('emails', ['m2'])} SELECT email_id, {text_label('label = 1')} AS truth, "
        f"m2_label AS predicted, (m2_z > 0) = (label = 1) AS correct FROM scored"
    )
    sql["empty_guard"] = (
        f"WITH {EMAILS}, partly AS (SELECT email_id, {EMPTIED} AS text FROM emails), "
        f"{scored('partly', ['m1'], 'email_id, text')}, "
        "guard AS (SELECT *, coalesce(text, '') = '' AS guarded FROM scored) "
        "SELECT email_id, guarded, CASE WHEN guarded THEN 'not spam' ELSE m1_label END AS label, "
        "CASE WHEN guarded THEN 0.0::DOUBLE ELSE m1_confidence END AS confidence, "
        "CASE WHEN guarded THEN 'empty' END AS record_intent, CASE WHEN guarded THEN FALSE END AS record_is_spam, "
        "CASE WHEN guarded THEN FALSE END AS record_is_system_generated, "
        "CASE WHEN guarded THEN 'empty body' END AS record_reason, CASE WHEN guarded THEN 'none' END AS record_category, "
        "CASE WHEN guarded THEN 'low' END AS record_priority, CASE WHEN guarded THEN 0.0::DOUBLE END AS record_confidence, "
        "CASE WHEN guarded THEN 'Email body is required' END AS error FROM guard"
    )

    row = "email_id, sender, text, label"
    sql["limit_first"] = f"WITH {EMAILS} SELECT {row} FROM emails ORDER BY email_id LIMIT 20"
    sql["limit_all_but_last"] = (
        f"WITH {EMAILS}, placed AS (SELECT *, row_number() OVER (ORDER BY email_id DESC) AS back FROM emails) "
        f"SELECT {row} FROM placed WHERE back > 20"
    )
    sql["limit_none"] = f"WITH {EMAILS} SELECT email_id, label FROM emails"
    sql["sample_rows"] = (
        f"WITH {EMAILS} SELECT email_id, text, label FROM emails ORDER BY md5('42:' || email_id), email_id LIMIT 200"
    )
    sql["head_by_class"] = (
        f"WITH {EMAILS} SELECT email_id, text, label FROM emails ORDER BY label DESC, email_id LIMIT 100"
    )

    sql["softmax_decide"] = (
        "WITH pairs AS (SELECT vec_id, embedding, unnest(range(1, len(embedding))) AS i FROM embeddings), "
        "logits AS (SELECT vec_id, (i - 1)::INT AS place, embedding[i]::DOUBLE AS a, embedding[i + 1]::DOUBLE AS b "
        f"FROM pairs) SELECT vec_id, place, {text_label('b > a')} AS label, "
        "round_even(1.0 / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 4) AS confidence FROM logits"
    )
    sql["softmax_many_classes"] = (
        "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), "
        "t AS (SELECT vec_id, e, list_max(e) AS top FROM v) "
        f"SELECT vec_id, {text_label('list_position(e, top) = 2')} AS label, "
        "round_even(1.0 / list_sum(list_transform(e, lambda x: exp(x - top))), 4) AS confidence FROM t"
    )
    sql["score_native"] = (
        f"WITH {EMAILS}, {scored('emails', ['m1'])} "
        "SELECT email_id, m1_label AS label, m1_confidence AS confidence FROM scored"
    )
    sql["score_all_long"] = (
        f"WITH {EMAILS}, {scored('emails', M4)}, {long_form(M4, 'email_id')} SELECT * FROM long"
    )
    # Both logits shifted by the constant one: z is their difference.
    sql["score_batch_udf"] = (
        f"WITH {EMAILS}, l AS (SELECT email_id, {BATCH_Z} AS z FROM emails) SELECT email_id, "
        f"{text_label('z > 0')} AS label, {confidence('z')} AS confidence, NULL::VARCHAR AS error FROM l"
    )
    docs = "docs AS (SELECT doc_id AS email_id, text FROM documents)"
    sql["failing_batches"] = (
        f"WITH {docs}, l AS (SELECT email_id, contains(lower(text), 'clown') AS bad, {BATCH_Z} AS z FROM docs) SELECT email_id, "
        f"CASE WHEN bad THEN 'not spam' ELSE {text_label('z > 0')} END AS label, "
        f"CASE WHEN bad THEN 0.0 ELSE {confidence('z')} END AS confidence, CASE WHEN bad THEN 'no clowns' END AS error FROM l"
    )
    vote = "((m1_label = 'spam')::INT + (m2_label = 'spam')::INT + (z > 0)::INT) * 2 > 3"
    sql["wrong_predictions"] = (
        f"WITH {COMPOSED}, {scored('texts', ['m1', 'm2'], f'email_id, label, {BATCH_Z} AS z')} SELECT email_id, "
        f"{text_label('label = 1')} AS true_label, {text_label(vote)} AS ensemble_prediction FROM scored WHERE ({vote}) <> (label = 1)"
    )
    sql["score_all_documents"] = (
        "WITH docs AS (SELECT doc_id AS email_id, text FROM documents), "
        f"{scored('docs', M3, f'email_id, {BATCH_Z} AS z')} SELECT email_id, "
        + ", ".join(f"{m}_label, {m}_confidence" for m in M3)
        + f", {text_label('z > 0')} AS batched_label, {confidence('z')} AS batched_confidence FROM scored"
    )

    sql["vote_counts"] = (
        f"WITH {EMAILS}, {scored('emails', M4)}, {long_form(M4, 'email_id')} SELECT email_id, "
        "count(*) FILTER (pred = 1) AS spam_votes, count(*) AS votes FROM long GROUP BY email_id"
    )
    sql["ensemble_vote"] = (
        f"WITH {EMAILS}, {scored('emails', M4)} SELECT email_id, {text_label(f'({VOTE3}) * 2 > 3')} AS of_three, "
        f"{text_label(f'({VOTE3} + (m4_z > 0)::INT) * 2 > 4')} AS of_four FROM scored"
    )
    sql["models_map"] = (
        f"WITH {EMAILS}, {scored('emails', M3)}, {long_form(M3, 'email_id, label AS truth')} SELECT email_id, model, "
        "predicted AS label, confidence, pred = truth AS correct FROM long"
    )

    sql["confusion"] = (
        f"WITH {EMAILS}, {scored('emails', M4)}, {long_form(M4, 'label')} SELECT model, {COUNTS} FROM long GROUP BY model"
    )
    sql["model_metrics"] = f"WITH {COMPOSED}, {LONG3} SELECT *, {METRICS} FROM counts"
    sql["model_metrics_raw"] = (
        f"WITH {EMAILS}, {scored('emails', M4)}, {long_form(M4, 'label')}, "
        f"counts AS (SELECT model, {COUNTS} FROM long GROUP BY model) SELECT *, {METRICS} FROM counts"
    )
    sql["model_metrics_by_source"] = (
        f"WITH {EMAILS}, {scored('emails', M3, 'sender, text, label')}, {long_form(M3, 'sender, label')}, "
        f"counts AS (SELECT sender, model, {COUNTS} FROM long GROUP BY sender, model) SELECT *, {METRICS} FROM counts"
    )
    sql["best_model"] = (
        f"WITH {EMAILS}, {scored('emails', M4)}, {long_form(M4, 'label')}, "
        f"counts AS (SELECT model, ordinal, {COUNTS} FROM long GROUP BY model, ordinal), "
        f"metrics AS (SELECT *, {METRICS} FROM counts) "
        "SELECT model AS best_model FROM metrics ORDER BY f1 DESC, ordinal LIMIT 1"
    )
    with_best = (
        "SELECT *, n AS dataset_size, (SELECT model FROM metrics ORDER BY f1 DESC, model LIMIT 1) AS best_model FROM metrics"
    )
    sql["benchmark_report"] = f"WITH {COMPOSED}, {LONG3}, metrics AS (SELECT *, {METRICS} FROM counts) {with_best}"
    first = COMPOSED.replace("AS text FROM emails)", "AS text FROM emails ORDER BY email_id LIMIT 100)")
    sql["benchmark_limited"] = f"WITH {first}, {LONG3}, metrics AS (SELECT *, {METRICS} FROM counts) {with_best}"
    sql["detailed_results"] = f"WITH {COMPOSED}, {scored('texts', M3)} {details(M3, f'({VOTE3}) * 2 > 3')}"
    keep = f"email_id, text, label, {BATCH_Z} AS batched_z"
    sql["benchmark_detailed"] = (
        f"WITH {COMPOSED}, {scored('texts', ['m1', 'm2'], keep)}, "
        f"combined AS (SELECT *, {text_label('batched_z > 0')} AS batched_label, {confidence('batched_z')} AS batched_confidence "
        "FROM scored) "
        + details(["m1", "m2", "batched"], "((m1_z > 0)::INT + (m2_z > 0)::INT + (batched_z > 0)::INT) * 2 > 3")
        .replace("FROM scored", "FROM combined")
    )
    sql["predict_raw"] = (
        f"WITH {EMAILS}, partly AS (SELECT email_id, {EMPTIED} AS text FROM emails), {predictions('partly')}"
    )
    sql["benchmark_single"] = (
        f"WITH {EMAILS}, said AS (SELECT label, ({BATCH_Z} > 0)::INT AS pred FROM emails), "
        f"counts AS (SELECT {COUNTS} FROM said) SELECT 'batched' AS model, *, {METRICS} FROM counts"
    )

    sql["parse_llm_json"] = (
        f"WITH {REPLIES} SELECT email_id, {', '.join(FIELDS)}, NOT is_object OR mistyped AS corrupt FROM parsed"
    )
    sql["validate_llm"] = violations("v1")
    sql["validate_llm_v2"] = violations("v2")

    sql["llm_v1_rows"] = f"WITH {EMAILS}, {answered('v1')} SELECT email_id, attempts, error, {RECORD} FROM answered"
    sql["llm_v2_rows"] = (
        f"WITH {EMAILS}, {answered('v2')} SELECT email_id, attempts, error, {RECORD}, latency_sec FROM answered"
    )
    sql["llm_v2_single_rows"] = (
        f"WITH {REQUESTS}, {answered('v2', 'requests', 'body', NO_BODY)} SELECT email_id, attempts, "
        f"CASE WHEN guarded THEN 'Email body is required' ELSE error END AS error, {REJECTED}, latency_sec FROM answered"
    )
    sql["llm_spam_rows"] = (
        f"WITH {EMAILS}, {answered('spam')} SELECT email_id, attempts, error, is_spam, category, intent, confidence, "
        f"{SPAM_REASON} AS reason FROM answered"
    )
    sql["llm_bulk_v1"] = bulk_v1()
    sql["llm_bulk_v2"] = (
        f"WITH {EMAILS}, {answered('v2')} SELECT email_id, sender, subject, {RECORD}, latency_sec FROM answered"
    )
    sql["llm_bulk_v1_summary"] = f"WITH {EMAILS} SELECT count(*) AS total_emails FROM emails"
    sql["llm_calls"] = (
        f"WITH {EMAILS}, {answered('v1')} SELECT email_id, attempts, error, "
        "CASE WHEN failed THEN NULL ELSE 0 END::INT AS n_violations FROM answered"
    )
    sql["llm_journal"] = (
        f"WITH {EMAILS}, {answered('v1')} SELECT email_id, attempts, error, "
        "CASE WHEN failed THEN NULL ELSE 0 END::INT AS n_violations, NOT failed AS kept FROM answered"
    )
    sql["latency_summary"] = (
        f"WITH {REQUESTS}, {answered('v2', 'requests', 'body', NO_BODY)} SELECT "
        "round_even(coalesce(avg(coalesce(latency_sec, 0.0)), 0.0), 3) AS avg_latency_sec, "
        "count(*) AS total_processed FROM answered"
    )
    sql["benchmark_llm"] = f"WITH {EMAILS}, {answered('v2')} {llm_benchmark(', latency_sec')}"
    sql["benchmark_llm_summary"] = (
        f"WITH {EMAILS}, {answered('v1')} SELECT round_even(avg((is_spam::INT = label)::INT), 4) AS accuracy, "
        "count(*) AS total_samples FROM answered"
    )
    sql["compare"] = comparison(logit("m1"))
    sql["compare_first"] = comparison(BATCH_Z, "ORDER BY email_id LIMIT 20")
    sql["flatten_result"] = f"WITH {EMAILS}, {answered('v1')} {llm_benchmark('')}"

    sql["list_mail_names"] = (
        "SELECT source || '/' || CASE doc_id % 3 WHEN 0 THEN '_sent_mail' WHEN 1 THEN '.inbox/old' ELSE 'all' END "
        "|| '/_' || doc_id || '.' AS name FROM documents"
    )
    sql["parse_mail"] = f"WITH {MAILS} SELECT * FROM mails"
    sql["archive_rows"] = f"WITH {ARCHIVE} SELECT * FROM archive"
    sql["benchmark_archive"] = (
        f"WITH {ARCHIVE}, {scored('texts', ['m2'])}, {long_form(['m2'], 'label')}, "
        f"counts AS (SELECT model, {COUNTS} FROM long GROUP BY model), "
        f"metrics AS (SELECT *, {METRICS} FROM counts) {with_best}"
    )
    sql["benchmark_archive_details"] = f"WITH {ARCHIVE}, {scored('texts', M3)} {details(M3, f'({VOTE3}) * 2 > 3')}"
    sql["read_class_folders"] = f"WITH {EMAILS} SELECT email_id, '' AS subject, text AS body, label FROM emails"
    nameless = f"{EMAILS}, corpus AS (SELECT email_id, '' AS sender, '' AS subject, text, label FROM emails)"
    sql["class_folder_benchmark"] = (
        f"WITH {nameless}, {answered('v1', 'corpus')} SELECT round_even(avg((is_spam::INT = label)::INT), 4) AS accuracy, "
        "count(*) AS total_samples FROM answered"
    )
    sql["emails_json"] = (
        f"WITH {REQUESTS} SELECT email_id, CASE WHEN email_id % 7 = 3 THEN '' ELSE sender END AS sender, "
        "CASE WHEN email_id % 7 = 5 THEN '' ELSE subject END AS subject, body, body IS NOT NULL AS accepted FROM requests"
    )
    sql["read_json_roundtrip"] = sql["detailed_results"]
    sql["read_csv_roundtrip"] = f"WITH {EMAILS} SELECT * FROM emails"
    sql["read_csv_any_order"] = sql["read_csv_ranges"] = sql["read_csv_roundtrip"]
    sql["read_texts_json"] = "SELECT doc_id AS email_id, CASE WHEN doc_id % 7 = 3 THEN '' ELSE text END AS text FROM documents"
    sql["report_parquet"] = (
        f"SELECT email_id, sender, intent, is_spam, priority, count(*) OVER () AS n_rows FROM ({bulk_v1()})"
    )

    sql["stream_scoring"] = (
        f"WITH {REQUESTS}, arrived AS (SELECT email_id, body AS text FROM requests WHERE body IS NOT NULL), "
        f"{predictions('arrived')}"
    )
    sql["stream_structured"] = (
        f"WITH {REQUESTS}, arrived AS (SELECT * FROM requests WHERE body IS NOT NULL), "
        f"{answered('v1', 'arrived', 'body', NO_BODY)} SELECT email_id, attempts, error, {GUARDED} FROM answered"
    )
    return sql
