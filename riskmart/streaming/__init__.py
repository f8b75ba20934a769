"""Structured Streaming jobs (``jobs``)."""
