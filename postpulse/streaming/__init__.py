"""Structured Streaming forms of ingest, dedupe, counts and run assignment."""
