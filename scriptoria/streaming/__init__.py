"""Structured Streaming: incremental scans and windowed event counts."""
