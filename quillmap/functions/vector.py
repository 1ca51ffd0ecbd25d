"""Vector expressions on array columns. Sums are taken in double precision, in element order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZERO = 0.0


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(_ZERO), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(_ZERO), lambda s, x: s + x * x))


def squared_distance(a: Column, b: Column) -> Column:
    """Direct differences: no cancellation between near-equal points."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(v: Column, eps: float = 1e-12) -> Column:
    """v / max(|v|, eps); the length is taken once, not for every element."""
    scaled = F.transform(F.array(F.struct(v.alias("v"), F.greatest(norm(v), F.lit(eps)).alias("n"))), lambda s: F.transform(s["v"], lambda x: x / s["n"]))
    return F.element_at(scaled, 1)


def truncate(v: Column, d: int) -> Column:
    """The first ``d`` dimensions, brought to length one again."""
    return unit(F.slice(v, 1, d))


def all_finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def low_kernel(r2: Column, a: float, b: float, legacy: bool = False) -> Column:
    """Similarity of two map points: 1/(1 + a r^2b), legacy 1/(1 + a |d|_2b) with the 2b-norm given as ``r2``; 1 at r = 0."""
    power = r2 if legacy else F.pow(r2, F.lit(float(b)))
    return F.when(r2 == 0, F.lit(1.0)).otherwise(F.lit(1.0) / (F.lit(1.0) + F.lit(float(a)) * power))


def half(v: Column) -> Column:
    """Values rounded to half precision (10 fraction bits, ties to even), as doubles; beyond the range infinite."""

    def one(x: Column) -> Column:
        size = F.abs(x)
        # Spacing of half-precision numbers at this size: 2^(e-10), subnormal below 2^-14.
        exponent = F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1e-300)))), F.lit(-14)).cast("double")
        step = F.pow(F.lit(2.0), exponent - 10)
        rounded = F.rint(x / step) * step
        return F.when(F.abs(rounded) > 65504.0, F.signum(x) * float("inf")).otherwise(rounded)

    return F.transform(v, one)
