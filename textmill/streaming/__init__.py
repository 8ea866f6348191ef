"""Structured Streaming forms of the log and call operators."""
