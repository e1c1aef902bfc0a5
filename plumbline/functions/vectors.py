"""Vectors as arrays of double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for different lengths, for a zero vector and for values that are not finite."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = dot(a, b) / norm
    return F.when((F.size(a) == F.size(b)) & (norm > 0) & ~F.isnan(norm) & (norm < F.lit(float("inf"))) & ~F.isnan(value), value)


def softmax(scores: Column) -> Column:
    """Probabilities, computed from the differences to the greatest score."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def thresholded_label(probabilities: Column, threshold: float, none: int = 0) -> Column:
    """Index (from 0) of the greatest probability if it reaches the threshold, else ``none``."""
    best = F.array_max(probabilities)
    return F.when(best >= threshold, (F.array_position(probabilities, best) - 1).cast("int")).otherwise(none)
