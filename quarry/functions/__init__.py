"""Scalar functions: text, paths, vectors, the query compiler and match spans."""
