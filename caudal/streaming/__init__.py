"""Structured Streaming forms of ingest, de-duplication and frequency."""
