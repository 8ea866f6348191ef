"""Sinks: logs and samples as lines of JSON."""
