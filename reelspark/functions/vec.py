"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(doubles(a), lambda x: x / by)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, with a small term that keeps zero vectors defined."""
    return 1 - dot(a, b) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def unit(a: Column) -> Column:
    """``a`` over its norm; a zero vector stays as it is; null unless all components are finite."""
    ok = (F.size(a) > 0) & F.forall(doubles(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok, F.when(norm(a) > 0, scaled(a, norm(a))).otherwise(doubles(a)))


def five_points(points: Column) -> Column:
    """A 5 x 2 array of finite numbers; 2 x 5 is transposed, anything else is null.

    Without functions of elements, which Spark interprets; ``points`` is named often, so it should be a column of its own.
    """
    p = points.cast("array<array<double>>")
    row = lambda k: F.get(p, F.lit(k))
    shape = lambda n, m: functools.reduce(lambda a, k: a & (F.size(row(k)) == m), range(n), F.size(p) == n)
    turned = F.array(*(F.array(*(F.get(row(j), F.lit(k)) for j in range(2))) for k in range(5)))
    # NaN is the largest number; where there are nulls, array_contains is null unless it finds its value.
    inf = float("inf")
    finite = (F.array_max(F.flatten(p)) < inf) & ~F.array_contains(F.flatten(p), F.lit(-inf))
    return F.when(finite, F.when(shape(5, 2), p).when(shape(2, 5), turned))
