"""Structured Streaming: ingest, step increments, breaches and incidents."""
