"""Cosine similarity as a column expression, without Python on the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def cosine(column: Column, vector: Sequence[float]) -> Column:
    """Similarity of an array column to a vector; null for null, empty or all-zero arrays and for other lengths."""
    own = F.transform(column, lambda x: x.cast("double"))
    other = F.array(*(F.lit(float(x)) for x in vector))
    length = sum(float(x) ** 2 for x in vector) ** 0.5
    dot = _sum(F.zip_with(own, other, lambda a, b: a * b))
    norm = F.sqrt(_sum(F.transform(own, lambda x: x * x))) * F.lit(length)
    return F.when((F.size(column) == len(vector)) & (norm > 0), dot / norm)
