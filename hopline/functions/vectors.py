"""Vector expressions over ``array<float>`` columns, computed in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: distances are compared and reported to this many decimals.
DISTANCE_DECIMALS = 6


def vector_literal(values: Sequence[float]) -> Column:
    """A query vector as an array literal; a Python argument, so of known size."""
    return F.array(*[F.lit(float(v)) for v in values])


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null when the lengths differ or an element is missing."""
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - a.b / (|a| |b|)``; null for a zero vector or different lengths."""
    scale = norm(a) * norm(b)
    return 1.0 - dot(a, b) / F.when(scale > 0, scale)


def rounded_distance(a: Column, b: Column) -> Column:
    """Distance to the reported precision, with -0.0 folded into 0.0."""
    scale = 10.0**DISTANCE_DECIMALS
    return F.rint(cosine_distance(a, b) * scale) / scale + 0.0


def l2_normalize(vector: Column) -> Column:
    """The vector scaled to length one; null for a zero vector."""
    length = norm(vector)
    scale = F.when(length > 0, length)
    return F.when(length > 0, F.transform(as_double(vector), lambda x: x / scale))
