"""Structured Streaming: ingest, latest positions, charging state, ingest statistics."""
