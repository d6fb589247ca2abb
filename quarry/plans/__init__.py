"""Composed pipelines and the catalogue of queries."""
