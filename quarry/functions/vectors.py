"""Vector functions on array columns and on numpy matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different or no length and for zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def cosine_from_distance(distance: Column) -> Column:
    return F.least(F.greatest(1 - distance * distance / 2, F.lit(0.0)), F.lit(1.0))


def normalize(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(a.cast("array<double>"))


def cosine_matrix(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1)
    unit = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)
    return unit @ unit.T
