"""Structured Streaming: post ingest with exactly-once recovery, and running counts."""
