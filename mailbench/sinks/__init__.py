"""Writers of tabular reports and JSON results."""

from mailbench.sinks.reports import Written, manifest_of, read_report, write_json, write_report

__all__ = ["Written", "manifest_of", "read_report", "write_json", "write_report"]
