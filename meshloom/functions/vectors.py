"""Arithmetic on array columns of a known number of dimensions, unrolled so that it stays in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def dot(a: Column | str, b: Column | str, dims: int) -> Column:
    a, b = _col(a), _col(b)
    return total(a[i] * b[i] for i in range(dims))


def scaled_difference(scale: Column, a: Column | str, b: Column | str, dims: int) -> Column:
    """scale * (b - a), element by element."""
    a, b = _col(a), _col(b)
    return F.array(*[scale * (b[i] - a[i]) for i in range(dims)])


def distance(a: Column | str, b: Column | str, dims: int) -> Column:
    a, b = _col(a), _col(b)
    return F.sqrt(total((a[i] - b[i]) * (a[i] - b[i]) for i in range(dims)))


def mean_arrays(df: DataFrame, keys: list[str], arrays: list[str], dims: int, weight: Column | None = None, more: list[Column] = ()) -> DataFrame:
    """Group means of array columns, weighted if asked; further aggregates may be added."""
    aggs = []
    for name in arrays:
        c = F.col(name)
        if weight is None:
            aggs.append(F.array(*[F.avg(c[i]) for i in range(dims)]).alias(name))
        else:
            aggs.append(F.array(*[F.sum(weight * c[i]) / F.sum(weight) for i in range(dims)]).alias(name))
    return df.groupBy(*keys).agg(*aggs, *more)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
