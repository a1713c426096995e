"""Column expressions over numeric arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(v: Column, length: Column) -> Column:
    """L2-normalised vector given its length; a zero vector is divided by one."""
    scale = F.when(length == 0.0, 1.0).otherwise(length)
    return F.transform(v, lambda x: x.cast("double") / scale)


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine from precomputed lengths; 0.0 when either vector is zero."""
    both = norm_a * norm_b
    return F.when(both == 0.0, 0.0).otherwise(dot(a, b) / F.when(both == 0.0, 1.0).otherwise(both))
