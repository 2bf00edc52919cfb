"""Structured Streaming forms of the quality checks."""
