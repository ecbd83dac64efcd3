"""Vector functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector has no length, null if their dimensions differ."""
    size = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.lit(None)).when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)
