"""Parlance: a Spark engine for conversational data."""
