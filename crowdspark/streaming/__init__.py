"""Streaming forms of the counters."""
