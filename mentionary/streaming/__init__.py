"""Incremental matching as Structured Streaming."""
