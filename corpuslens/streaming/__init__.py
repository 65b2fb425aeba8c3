"""Structured Streaming forms of the usage, quota and event operators."""
