"""Structured Streaming forms of the sequential operators."""
