"""Structured Streaming forms of the time-bucketed reports."""
