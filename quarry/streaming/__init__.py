"""Structured Streaming maintenance of an index."""
