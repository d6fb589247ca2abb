"""Spark-first hybrid retrieval and corpus preparation."""
