"""Scoring of e-mails as their files arrive."""

from mailbench.streaming.analyze import analyze_stream, read_stream

__all__ = ["analyze_stream", "read_stream"]
