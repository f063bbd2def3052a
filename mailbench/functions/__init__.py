"""Column functions: texts, labels, decisions, structured replies."""

from mailbench.functions.decisions import round_n, softmax_decide
from mailbench.functions.labels import correct, label_to_text, text_to_label
from mailbench.functions.replies import parse_llm_json, validate_llm
from mailbench.functions.text import (
    compose_for,
    compose_text,
    heuristic_label,
    llm_prompt_v1,
    llm_prompt_v2,
    min_length_filter,
    prefix,
    strip_text,
)

__all__ = [
    "compose_for",
    "compose_text",
    "correct",
    "heuristic_label",
    "label_to_text",
    "llm_prompt_v1",
    "llm_prompt_v2",
    "min_length_filter",
    "parse_llm_json",
    "prefix",
    "round_n",
    "softmax_decide",
    "strip_text",
    "text_to_label",
    "validate_llm",
]
