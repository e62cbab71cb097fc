"""Readers, sinks, tolerant parsing and sampling."""
