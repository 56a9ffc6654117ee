"""Array expressions for dense vectors, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v: Column | str) -> Column:
    return _c(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str, guard: float = 0.0) -> Column:
    d = norm(a) * norm(b)
    return dot(a, b) / (F.greatest(d, F.lit(guard)) if guard else d)


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def angular(a: Column | str, b: Column | str) -> Column:
    return F.acos(0.99 * cosine(a, b))


def unit(a: Column | str, guard: float = 1e-24) -> Column:
    n = F.greatest(norm(a), F.lit(guard))
    return F.transform(_c(a), lambda x: x / n)


def zero_bad(a: Column | str) -> Column:
    """NaN and infinities as 0."""
    return F.transform(_c(a), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))


def is_whole(a: Column | str) -> Column:
    """Neither null nor with a NaN."""
    return _c(a).isNotNull() & ~F.exists(_c(a), lambda x: F.isnan(x))


def vector_sum(v: Column | str, d: int) -> Column:
    """Aggregate: element-wise sum of arrays of length ``d``."""
    return F.array(*(F.sum(_c(v)[i]) for i in range(d)))


def safe_log(x: Column | str, guard: float = 1e-12) -> Column:
    return F.ln(F.greatest(_c(x), F.lit(guard)))
