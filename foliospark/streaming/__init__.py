"""Continuous ingestion on Structured Streaming."""
