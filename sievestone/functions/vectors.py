"""Vector functions on array columns; single precision is widened before any sum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0 or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def similarity(distance: Column, mode: str = "legacy") -> Column:
    """1 / (1 + d), or calibrated_v1: 1 / (1 + d * d); d below 0 counts as 0."""
    d = F.greatest(F.lit(0.0), distance)
    if mode == "legacy":
        s = 1.0 / (1.0 + d)
    elif mode == "calibrated_v1":
        s = 1.0 / (1.0 + d * d)
    else:
        raise ValueError(f"unknown calibration mode: {mode}")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))
