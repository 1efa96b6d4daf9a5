"""Vector maths as column expressions over ArrayType; everything is computed in double."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("array<double>")


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """a / |a|; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -dot(a, b)


METRICS: dict[str, Callable[[Column, Column], Column]] = {"cosine": cosine_distance, "euclid": l2_distance, "dot": negative_inner_product}


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {sorted(METRICS)}")
    return METRICS[metric](a, b)


def checked(a: Column, dimensions: int) -> Column:
    """a, or an error in the row whose vector has another length."""
    return F.when(F.size(a) == dimensions, a).otherwise(F.raise_error(F.concat(F.lit(f"vector of {dimensions} dimensions expected, got "), F.size(a).cast("string"))))


def similarity_of(metric: str, dist: Column) -> Column:
    """Distance to similarity: 1 - d for cosine, -d for dot, 1 / max(d, 1e-8) for euclid."""
    return {"cosine": 1 - dist, "dot": -dist, "euclid": 1 / F.greatest(dist, F.lit(1e-8))}[metric]


def soft_extreme(values: Column, beta: float) -> Column:
    """Sum of values weighted by softmax(beta * values): near the maximum for a large beta, the minimum for a large -beta."""
    top = F.array_max(F.transform(values, lambda x: x * beta))
    weight = F.transform(values, lambda x: F.exp(x * beta - top))
    return dot(values, weight) / _sum(weight)


def masked_mean(rows: Column, mask: Column, dimensions: int) -> Column:
    """Mean of the vectors whose mask is set; null if there is none."""
    kept = F.filter(F.zip_with(rows, mask, lambda r, m: F.when(m.cast("boolean"), r)), lambda r: r.isNotNull())
    zero = F.array_repeat(F.lit(0.0), dimensions)
    total = F.aggregate(kept, zero, lambda acc, r: F.zip_with(acc, r, lambda x, y: x + y))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))


def padded(rows: Column, length: int, dimensions: int) -> Column:
    """rows cut or filled with zero vectors to a length."""
    zero = F.array_repeat(F.lit(0.0), dimensions)
    return F.slice(F.concat(rows, F.array_repeat(zero, length)), 1, length)
