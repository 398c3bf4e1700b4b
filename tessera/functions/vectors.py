"""Features of numeric arrays, evaluated in the JVM and folded from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def l1(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x))


def l2(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def linf(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))


def sparsity(v: Column, eps: float = 1e-9) -> Column:
    """Share of entries that are nought."""
    return F.size(F.filter(v, lambda x: F.abs(x) <= eps)).cast("double") / F.size(v)


def entropy(v: Column) -> Column:
    """Shannon entropy, in nats, of absolute entries as shares; noughts are skipped."""
    norm = l1(v)
    return F.aggregate(v, F.lit(0.0), lambda s, x: F.when(x == 0, s).otherwise(s - F.abs(x) / norm * F.log(F.abs(x) / norm)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (l2(a) * l2(b))


def pearson(a: Column, b: Column) -> Column:
    n = F.size(a)
    sa, sb = total(a), total(b)
    return (n * dot(a, b) - sa * sb) / (F.sqrt(n * dot(a, a) - sa * sa) * F.sqrt(n * dot(b, b) - sb * sb))
