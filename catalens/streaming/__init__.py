"""Structured Streaming forms of the annotation and execution-log operators."""
