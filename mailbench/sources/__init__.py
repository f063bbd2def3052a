"""Readers for labelled CSV, JSON records, mail archives and class folders."""

from mailbench.sources.files import list_folder, list_mail_paths, read_files
from mailbench.sources.mail import parse_mail, read_class_folders, read_mail
from mailbench.sources.tables import (
    emails_from_rows,
    labeled_csv_rejects,
    read_dataset,
    read_emails_json,
    read_labeled_csv,
    read_texts_json,
    split_rejects,
)

__all__ = [
    "emails_from_rows",
    "labeled_csv_rejects",
    "list_folder",
    "list_mail_paths",
    "parse_mail",
    "read_class_folders",
    "read_dataset",
    "read_emails_json",
    "read_files",
    "read_labeled_csv",
    "read_mail",
    "read_texts_json",
    "split_rejects",
]
