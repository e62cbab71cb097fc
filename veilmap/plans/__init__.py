"""Registered queries: model views, Spark plans and their SQL oracles."""
