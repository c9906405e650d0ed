"""Dot product, norm and cosine of array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIMILARITY_UNIT = 1_000_000


def dot(a: Column, b: Column) -> Column:
    """Zero where the lengths differ."""
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Zero where either norm is zero."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def similarity_score(cos: Column) -> Column:
    """A cosine in whole millionths, cut toward zero."""
    return (cos * SIMILARITY_UNIT).cast("bigint")
