"""Mail files: MIME messages, and plain texts sorted into one folder per class."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from email import message_from_bytes, policy
from email.message import EmailMessage

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailbench.schemas import MAIL, field_names
from mailbench.sources.files import CONTENT_BYTES, PASSED_OVER, Stores, attempted, list_folder, open_files, spread_paths

# Folder names and their labels.
CLASS_FOLDERS = {"spam": 1, "ham": 0}

FIRST_BLOCK = 64 << 10  # bytes of a mail read at first
RETRIED = OSError  # of a store, after all attempts


def _text(raw: bytes | None) -> str:
    """UTF-8, whatever charset the mail names; invalid bytes are dropped."""
    return (raw or b"").decode("utf-8", errors="ignore")


def _header(message: EmailMessage, name: str) -> str:
    return str(message.get(name, "")).encode("utf-8", errors="ignore").decode("utf-8")


def _payload(message: EmailMessage) -> bytes | None:
    """The decoded payload of a simple mail, or of the first non-empty plain-text part."""
    if not message.is_multipart():
        return message.get_payload(decode=True)
    plain = (p for p in message.walk() if p.get_content_type() == "text/plain")
    return next(filter(None, (p.get_payload(decode=True) for p in plain)), None)


def _fields(path: str, message: EmailMessage) -> tuple:
    text = _text(_payload(message))
    return path, _header(message, "from"), _header(message, "subject"), text, None


def _parsed(content: bytes) -> EmailMessage:
    return message_from_bytes(content, policy=policy.default)


def _settled(message: EmailMessage) -> bool:
    """Whether the first lines of a mail already hold the text that the whole mail would give: a part has begun behind it."""
    if not message.is_multipart():
        return False
    parts = list(message.walk())
    return any(p.get_content_type() == "text/plain" and p.get_payload(decode=True) for p in parts[:-1])


def read_message(file, first_block: int = FIRST_BLOCK) -> EmailMessage:
    """Parse an open mail, reading no further than the part behind the first text that is not empty.

    The parser goes line by line, so whole lines read so far have the meaning they have in the whole mail.  Each try has four times
    the bytes of the one before: attachments behind the text are not read, and what is read is parsed about once.
    """
    content, block = b"", first_block
    while True:
        more = file.read(block)
        content += more
        if len(more) < block:
            return _parsed(content)
        try:
            message = _parsed(content[:content.rfind(b"\n") + 1])
            if _settled(message):
                return message
        except Exception:
            pass  # what is wrong is told by the whole mail
        block = 3 * len(content)


def _parser(keep_bad: bool, message_of):
    """Rows of fields; ``message_of`` gives paths and, for each, a function that gives its message."""
    columns = [*field_names(MAIL), "error"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for path, message in message_of(batch):
                try:
                    rows.append(_fields(path, message()))
                except PASSED_OVER:
                    continue
                except RETRIED:
                    raise
                except Exception as problem:
                    if keep_bad:
                        rows.append((path, None, None, None, str(problem) or type(problem).__name__))
                held += len(rows[-1][3] or "") if rows else 0
                if held >= CONTENT_BYTES:
                    yield frame(rows)
                    rows, held = [], 0
            yield frame(rows)

    def frame(rows):
        out = pd.DataFrame(rows, columns=columns)
        return out if keep_bad else out.drop(columns="error")

    return parse, f"{MAIL}, error string" if keep_bad else MAIL


def _of_contents(batch: pd.DataFrame):
    for path, content in zip(batch["path"], batch["content"]):
        yield path, lambda: _parsed(bytes(content))


def _of_files(batch: pd.DataFrame):
    stores = Stores()

    def opened(path):
        with stores.open(path) as file:
            return read_message(file)

    for path in batch["path"]:
        yield path, lambda: attempted(lambda: opened(path))


def parse_mail(raw: DataFrame, keep_bad: bool = False) -> DataFrame:
    """``path, content`` to ``path, from, subject, text``.

    Mails the parser fails on are left out, or kept with an ``error`` and null fields.
    """
    parse, schema = _parser(keep_bad, _of_contents)
    return raw.select("path", "content").mapInPandas(parse, schema)


def read_mail(paths: DataFrame, keep_bad: bool = False, partitions: int | None = None) -> DataFrame:
    """Open and parse in one pass: raw contents never leave the Python worker, and a file is read no further than its text.

    Files that are gone or forbidden are left out; other errors of a store are tried again and then end the job.
    """
    parse, schema = _parser(keep_bad, _of_files)
    return spread_paths(paths, partitions).mapInPandas(parse, schema)


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in open_files(batches):
        bodies = [_text(content) for content in batch["content"]]
        yield pd.DataFrame({"path": batch["path"], "body": bodies}, dtype=object)


def read_class_folders(spark: SparkSession, root: str, classes: Mapping[str, int] = CLASS_FOLDERS,
                       paths: DataFrame | None = None) -> DataFrame:
    """``path, subject, body, label`` of the files directly in one folder per class.

    The subject is ''.  Line ends become newlines, as in text mode.  ``paths`` may give
    a selection of :func:`class_paths` to open only those.
    """
    chosen = class_paths(spark, root, classes) if paths is None else paths
    texts = spread_paths(chosen).mapInPandas(_decode, "path string, body string")
    return texts.select(
        "path",
        F.lit("").alias("subject"),
        F.regexp_replace("body", "\r\n?", "\n").alias("body"),
        _class_label(classes).alias("label"),
    )


def class_paths(spark: SparkSession, root: str, classes: Mapping[str, int] = CLASS_FOLDERS) -> DataFrame:
    """``path, label`` of those files, none of them opened."""
    folders = [f"{root.rstrip('/')}/{name}" for name in classes]
    return list_folder(spark, *folders).select("path", _class_label(classes).alias("label"))


def _class_label(classes: Mapping[str, int]):
    folder = F.regexp_extract("path", r"([^/]*)/[^/]*\z", 1)
    label = F.lit(None).cast("int")
    for name, value in classes.items():
        label = F.when(folder == name, value).otherwise(label)
    return label
