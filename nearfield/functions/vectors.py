"""Vector functions on array columns, in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    """Sum of products from the first coordinate to the last; null if the sizes differ."""
    return F.aggregate(F.zip_with(as_doubles(left), as_doubles(right), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def squared_distance(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(left), as_doubles(right), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)


def squared_norm(v: Column) -> Column:
    return F.aggregate(as_doubles(v), F.lit(0.0), lambda a, x: a + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def unit(v: Column) -> Column:
    """v over its norm, in doubles; scaled by the largest magnitude first, so squares can't overflow. Null for a zero vector."""
    largest = F.array_max(F.transform(as_doubles(v), F.abs))
    scaled = F.transform(F.array(F.struct(as_doubles(v).alias("v"), F.nullif(largest, F.lit(0.0)).alias("m"))), lambda s: F.transform(s["v"], lambda x: x / s["m"]))[0]
    return F.transform(F.array(F.struct(scaled.alias("v"), norm(scaled).alias("n"))), lambda s: F.transform(s["v"], lambda x: x / s["n"]))[0]


def squared_distance_by_norms(left: Column, right: Column, left_sq: Column, right_sq: Column) -> Column:
    """|l|^2 + |r|^2 - 2 l.r with stored squared norms, never below zero."""
    return F.greatest(left_sq + right_sq - 2 * dot(left, right), F.lit(0.0))
