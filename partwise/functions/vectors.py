"""Functions of array<double> columns. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def cleaned(c: Column) -> Column:
    """Null, NaN and infinite components become 0."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.transform(doubles(c), lambda x: F.when(bad(x), F.lit(0.0)).otherwise(x))


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(c: Column, p: float = 2.0) -> Column:
    return F.pow(total(F.transform(c, lambda x: F.pow(F.abs(x), F.lit(p)))), F.lit(1.0 / p))


def zeros(c: Column) -> Column:
    return F.size(F.filter(c, lambda x: x == 0))


def is_binary(c: Column, least: int = 128) -> Column:
    return (F.size(c) >= least) & F.forall(c, lambda x: (x == 0) | (x == 1))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def tanimoto_distance(a: Column, b: Column) -> Column:
    """Of two binary vectors; 1 if neither has a bit."""
    both, any_ = dot(a, b), total(F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    return F.when(any_ == 0, F.lit(1.0)).otherwise(F.lit(1.0) - both / any_)
