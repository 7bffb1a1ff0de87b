"""Distances of float arrays as expressions; smaller is closer. Arrays of different lengths have none (null)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, term) -> Column:
    parts = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), term)
    return F.when(F.size(a) == F.size(b), F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))


def inner_product(a: Column, b: Column) -> Column:
    return -_sum(a, b, lambda x, y: x * y)


def cosine(a: Column, b: Column) -> Column:
    """1 - cos, 1 where a norm is 0; null of an element that is null, NaN where it isn't defined."""
    norm = _sum(a, a, lambda x, y: x * y) * _sum(b, b, lambda x, y: x * y)
    cos = _sum(a, b, lambda x, y: x * y) / F.sqrt(norm)
    held = F.when(F.isnan(cos), cos).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))  # least and greatest pass over null
    return F.when(F.size(a) == F.size(b), F.when(norm > 0, 1 - held).when(norm == 0, F.lit(1.0)))


METRICS = {"l2": l2, "cosine": cosine, "inner_product": inner_product}
