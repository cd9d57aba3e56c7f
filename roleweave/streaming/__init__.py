"""Structured Streaming forms of the incremental run."""
