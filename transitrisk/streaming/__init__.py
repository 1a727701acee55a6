"""Incremental ingest of daily actuals files with Structured Streaming."""
