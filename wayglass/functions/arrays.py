"""Column functions over fixed-length numeric arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def mean_abs(a: Column) -> Column:
    return mean(F.transform(a, lambda x: F.abs(x)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def each_with(a: Column, value: Column, f) -> Column:
    """f(x, value) for each x. value is worked out once a row; captured by a lambda it would be worked out for each element."""
    return F.zip_with(a, F.array_repeat(value, F.size(a)), f)


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def std_pop(a: Column) -> Column:
    return F.sqrt(F.greatest(mean(F.transform(a, lambda x: x * x)) - mean(a) * mean(a), F.lit(0.0)))


def steps(a: Column, n: int) -> Column:
    """Differences between neighbours of an array of n."""
    return F.zip_with(F.slice(a, 2, n - 1), F.slice(a, 1, n - 1), lambda x, y: x - y)


def median(a: Column, n: int) -> Column:
    s = F.sort_array(a)
    return (F.element_at(s, n // 2) + F.element_at(s, n // 2 + 1)) / 2 if n % 2 == 0 else F.element_at(s, n // 2 + 1)


def slope(a: Column, n: int) -> Column:
    """Least-squares slope against 0..n-1."""
    centre, norm = (n - 1) / 2, n * (n * n - 1) / 12
    return F.aggregate(F.transform(a, lambda x, i: x * (i - F.lit(centre))), F.lit(0.0), lambda s, x: s + x) / F.lit(norm)


def cosine(a: Column, b: Column) -> Column:
    """Cosine clipped to [0, 1]; two zero vectors are alike, one is not."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(F.least(F.greatest(dot(a, b) / (na * nb), F.lit(0.0)), F.lit(1.0)))


def robust_normalise(a: Column, n: int = 12) -> Column:
    """(x - median) / max(1.4826 MAD, 1), clipped at +-8."""
    centred = each_with(a, median(a, n), lambda x, m: x - m)
    mad = median(F.transform(centred, lambda x: F.abs(x)), n)
    return each_with(centred, F.greatest(mad * 1.4826, F.lit(1.0)), lambda x, s: F.greatest(F.least(x / s, F.lit(8.0)), F.lit(-8.0)))
