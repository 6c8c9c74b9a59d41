"""Vector functions over ``array<float|double>`` columns, JVM-side.

Dot products, norms, cosine and pair distances are written with ``zip_with``
and ``aggregate`` so they stay inside the JVM; the arithmetic is in double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b, cast: bool = True) -> Column:
    """Σ a_i·b_i in double; ``cast=False`` when both are already ``array<double>`` (skips a cast per element)."""
    if not cast:
        return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a, b, assume_unit: bool = False) -> Column:
    """Cosine similarity (0 when a vector is all zeros); ``assume_unit`` skips the norms."""
    d = dot(a, b)
    if assume_unit:
        return d
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(d / den)


def l2_normalize(a) -> Column:
    """Divide by the Euclidean norm (a zero vector stays zero).

    The norm is accumulated once and the division happens in the finishing
    lambda, so the cost is linear in the dimension.
    """
    arr = _c(a)
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"),
                       lambda ss: F.transform(arr, lambda x: F.when(ss > 0, x.cast("double") / F.sqrt(ss))
                                              .otherwise(F.lit(0.0))))


def add_scaled(acc, vec, w) -> Column:
    """acc + w·vec, element-wise."""
    return F.zip_with(acc, vec, lambda a, x: a + w * x.cast("double"))


def distance(a, b, metric: str = "euclidean") -> Column:
    """Euclidean, manhattan or cosine distance (1 − cosine)."""
    if metric == "euclidean":
        return F.sqrt(_sum(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))
    if metric == "manhattan":
        return _sum(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y)))
    if metric == "cosine":
        return F.lit(1.0) - cosine(a, b)
    raise ValueError(f"unknown distance {metric!r}")


def similarity(a, b, metric: str = "cosine") -> Column:
    """Similarity used by re-rankers: cosine, dot, or the cosine *distance*."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "dot":
        return dot(a, b)
    if metric == "cosine_distance":
        return F.lit(1.0) - cosine(a, b)
    raise ValueError(f"unknown similarity {metric!r}")


def hash_bucket(term, dim: int) -> Column:
    """Bucket of a term for the hash encoder: first 24 bits of md5, modulo dim."""
    return F.pmod(F.conv(F.substring(F.md5(_c(term)), 1, 6), 16, 10).cast("long"), F.lit(dim))
