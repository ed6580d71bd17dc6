"""Incremental loads as Structured Streaming jobs."""
