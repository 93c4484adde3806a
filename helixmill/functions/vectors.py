"""State geometry on arrays, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _with(a: Column, b: Column, f) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _with(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_with(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column, *, zero: str = "error") -> Column:
    """Clamped to [-1, 1]; a zero norm is an error, or 0.0 with zero="flat"."""
    size = norm(a) * norm(b)
    none = F.raise_error(F.lit("zero norm")).cast("double") if zero == "error" else F.lit(0.0)
    return F.when(size == 0, none).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(size, F.lit(0.0)))))


def normalised(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: (x.cast("double") / F.when(size == 0, F.raise_error(F.lit("zero norm")).cast("double")).otherwise(size)).cast("float"))


def region_l2(a: Column, b: Column, places: list[int]) -> Column:
    at = F.array(*map(F.lit, places))
    return l2(F.transform(at, lambda i: F.element_at(a, i + 1)), F.transform(at, lambda i: F.element_at(b, i + 1)))


def chunked_l2(a: Column, b: Column, chunk: int, how: str) -> Column:
    """Mean, max or median of the L2 distances of chunks."""
    starts = F.sequence(F.lit(1), F.size(a), F.lit(chunk))
    parts = F.array_sort(F.transform(starts, lambda i: l2(F.slice(a, i, F.lit(chunk)), F.slice(b, i, F.lit(chunk)))))
    if how == "mean":
        return _sum(parts) / F.size(parts)
    if how == "max":
        return F.array_max(parts)
    n = F.size(parts)
    return (F.element_at(parts, F.floor((n + 1) / F.lit(2)).cast("int")) + F.element_at(parts, F.floor((n + 2) / F.lit(2)).cast("int"))) / F.lit(2.0)


def edit_geometry(ref: Column, alt: Column) -> list[Column]:
    return [norm(ref).alias("norm_s_ref"), norm(alt).alias("norm_s_alt"), cosine(ref, alt).alias("cos_ref_alt"), l2(ref, alt).alias("l2_delta"), (l2(ref, alt) / norm(ref)).alias("rel_delta")]


def prediction_loss(prediction: Column, target: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    mse = _with(prediction, target, lambda x, y: (x - y) * (x - y)) / F.size(target)
    return F.lit(alpha) * (F.lit(1.0) - cosine(prediction, target, zero="flat")) + F.lit(beta) * mse


def mean_pool(rows: Column, first: Column, last: Column) -> Column:
    """Element-wise mean of the vectors first to last (0-based, both included) of an array of arrays."""
    part = F.slice(rows, first + 1, last - first + 1)
    total = F.aggregate(part, F.transform(F.element_at(rows, 1), lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda p, q: p + q.cast("double")))
    return F.transform(total, lambda x: (x / F.size(part)).cast("float"))


def pool(tokens: Column, first: Column, last: Column, *, centre: Column | None = None, radius: int = 0) -> Column:
    """Mean of the content tokens first to last, or of those within `radius` of the centre that are content."""
    if centre is None:
        return mean_pool(tokens, first, last)
    return mean_pool(tokens, F.greatest(first, centre - radius), F.least(last, centre + radius))
