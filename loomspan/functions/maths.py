"""Scalar expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(*parts: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(reduce(lambda a, b: a + b, (p * p for p in parts)))


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts: reproducible anywhere, unlike a seeded generator."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


def cubic_kernel(x: Column) -> Column:
    """The weight of a sample at distance x for cubic resampling."""
    # fixed values: (21x^3 - 36x^2 + 16) / 18 below 1, (-7x^3 + 36x^2 - 60x + 32) / 18 from 1 to 2, else 0
    a = F.abs(x)
    return (
        F.when(a < 1, (21 * a**3 - 36 * a**2 + 16) / 18)
        .when(a < 2, (-7 * a**3 + 36 * a**2 - 60 * a + 32) / 18)
        .otherwise(F.lit(0.0))
    )
