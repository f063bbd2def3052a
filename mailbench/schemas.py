"""Schemas every source, scorer and report agrees on (DDL strings)."""

EMAIL_IN = "email_id long, sender string, subject string, body string"
LABELED = "email_id long, sender string, subject string, text string, label int"
MAIL = "path string, `from` string, subject string, text string"

PREDICTION = "label string, confidence double, error string"

# The structured record of the seven-field classifiers and of the five-field one.
LLM_OUT = (
    "intent string, is_spam boolean, is_system_generated boolean, reason string, "
    "category string, priority string, confidence double"
)
LLM_SPAM = (
    "is_spam boolean, category string, intent string, confidence double, reason string"
)

METRICS = (
    "model string, n long, tp long, fp long, fn long, tn long, "
    "accuracy double, precision double, recall double, f1 double"
)


def field_names(ddl: str) -> list[str]:
    """Column names of one of the flat DDL strings above, in order."""
    return [part.split()[0].strip("`") for part in ddl.split(",")]
