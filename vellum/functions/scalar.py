"""Double-valued scalar functions with IEEE results, for computed fields.

Virtual fields are Spark SQL expressions (``F.expr``); these stand in where
Spark would give null or raise: logarithms of non-positive numbers, division by
zero, missing values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.geo import haversine

INF, NAN = float("inf"), float("nan")


def number(x: Column) -> Column:
    """A missing value counts as zero."""
    return F.coalesce(x.cast("double"), F.lit(0.0))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def divide(a: Column, b: Column) -> Column:
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def haversin_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine(lat1, lon1, lat2, lon2) / 1000


def recency(seconds: Column, now: float, half_life: float) -> Column:
    """Boost of a time: 1 now, halved after each half-life, never above 1."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(now) - seconds, F.lit(0.0)) / half_life)
