"""Vectors as arrays: products, norms, distances, quantisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


METRICS = {"cosine": cosine, "dot": dot, "euclidean": euclidean, "manhattan": manhattan}
#: Those of which less is nearer.
DISTANCES = {"euclidean", "manhattan"}


def normalised(v: Column) -> Column:
    n = norm(v)
    return F.transform(doubles(v), lambda x: F.try_divide(x, n))


def is_normalised(v: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(norm(v) - 1) <= tolerance


def shortened(v: Column, dimensions: int) -> Column:
    """The first components; of models trained for it they are a vector of their own."""
    return F.slice(v, 1, dimensions)


def int8(v: Column, scale: Column | float) -> Column:
    """Components as whole numbers from -127 to 127, in units of ``scale / 127``."""
    return F.transform(doubles(v), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x / scale * 127))).cast("int"))


def signs(v: Column) -> Column:
    """A 1 for each positive component, as text."""
    return F.array_join(F.transform(v, lambda x: F.when(x > 0, "1").otherwise("0")), "")


def sign_agreement(a: Column, b: Column) -> Column:
    """In how many components two vectors have the same sign."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x > 0) == (y > 0)).cast("int")), F.lit(0), lambda acc, x: acc + x)
