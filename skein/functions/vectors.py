"""Vector arithmetic on array columns, in doubles and without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if either vector is zero, so that it's always finite."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / norm)


def sanitize(v: Column, dims: int) -> Column:
    """The vector, or zeros if its length is wrong or an element isn't finite."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dims)
    return F.when(v.isNull() | (F.size(v) != dims) | odd, zero).otherwise(v)


def storable(v: Column) -> Column:
    """Whether a vector may enter the cache: finite and not all zero."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
