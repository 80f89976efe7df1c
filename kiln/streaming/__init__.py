"""Structured Streaming: replay fitted rules (and a model) on a stream of new files."""

from kiln.streaming.replay import stream_apply_rules, start_rules_stream  # noqa: F401
