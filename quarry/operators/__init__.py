"""Retrieval, evaluation, tuning, graph, checks and index maintenance on DataFrames."""
