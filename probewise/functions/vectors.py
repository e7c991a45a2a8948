"""Vector arithmetic on array columns, evaluated in the JVM.

These forms are exact and run in any plan, streams included. For wide vectors
and many bank rows the Arrow forms in ``kernels`` do the same with one matrix
product per batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

EPS = 1e-8


def as_doubles(x: Column) -> Column:
    return x.cast("array<double>")


def literal_vector(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values]).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))


def l2_normalize(x: Column, eps: float = EPS) -> Column:
    length = norm(x)
    return F.transform(x, lambda v: v / (length + F.lit(eps)))


def sign_code(x: Column) -> Column:
    """+1 where a component is at least zero, else -1."""
    return F.transform(x, lambda v: F.when(v >= 0, F.lit(1)).otherwise(F.lit(-1)))


def hamming_similarity(code: Column, other: Column) -> Column:
    return dot(code.cast("array<double>"), other.cast("array<double>")) / F.size(code)


def hamming_distance(similarity: Column) -> Column:
    return F.lit(0.5) * (F.lit(1.0) - similarity)


def quantize(z: Column, scale: float | Column, qmin: int, qmax: int) -> Column:
    """Uniform quantiser, rounding halves to even."""
    step = F.lit(scale) if isinstance(scale, (int, float)) else scale
    return F.transform(
        z, lambda v: F.greatest(F.lit(float(qmin)), F.least(F.lit(float(qmax)), F.rint(v / step))) * step
    )


def remove_direction(x: Column, direction: Column) -> Column:
    """``x`` without its part along a unit ``direction``."""
    along = dot(x, direction)
    return F.zip_with(x, direction, lambda v, q: v - along * q)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def first_argmax(scores: Column) -> Column:
    """Zero-based index of the first largest element."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
