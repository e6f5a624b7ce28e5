"""Vector expressions.  Vectors are stored as 32-bit floats; all arithmetic is 64-bit, in order, so that
results are the same bit for bit on any partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

COSINE, EUCLIDEAN = "cosine_distance", "euclidean_squared"
METRICS = (COSINE, EUCLIDEAN)
ZERO_NORM = 1e-6


def wide(vector: Column) -> Column:
    return vector.cast("array<double>")


def literal(vector: Sequence[float]) -> Column:
    """A constant array.  One parsed text takes a fraction of the time of a call for each component."""
    values = [float(x) for x in vector]
    if not values or not all(map(math.isfinite, values)):
        return F.array(*[F.lit(x) for x in values]).cast("array<double>")
    return F.expr(f"array({', '.join(f'{x!r}D' for x in values)})")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(wide(vector), F.lit(0.0), lambda s, x: s + x * x))


def normalize(vector: Column) -> Column:
    """Unit length; a vector of norm 1e-6 or less becomes the zero vector."""
    n = norm(vector)
    return F.transform(wide(vector), lambda x: F.when(n <= ZERO_NORM, F.lit(0.0)).otherwise(x / n))


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - dot``: both vectors are taken to be normalized."""
    return F.lit(1.0) - dot(a, b)


def euclidean_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(metric: str, a: Column, b: Column) -> Column:
    """The expression for a metric, chosen while the plan is built."""
    if metric == COSINE:
        return cosine_distance(a, b)
    if metric == EUCLIDEAN:
        return euclidean_squared(a, b)
    raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")


def normalized(vector: Sequence[float]) -> list[float]:
    """``normalize`` for a query vector on the driver."""
    n = sum(x * x for x in map(float, vector)) ** 0.5
    return [0.0 if n <= ZERO_NORM else float(x) / n for x in vector]
