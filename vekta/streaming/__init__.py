"""Structured Streaming forms of ingest and progress metrics."""
