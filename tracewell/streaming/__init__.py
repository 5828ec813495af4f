"""Structured Streaming forms of the detection rules."""
