"""Structured Streaming variants of the containment query."""
