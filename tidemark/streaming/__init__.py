"""Structured Streaming forms of the ingest and history jobs."""
