"""Distance and kernel expressions over array columns; all in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def euclidean(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance of two arrays of equal length."""
    return F.sqrt(squared_distance(a, b))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def gaussian_kernel(d2: Column, sigma: float) -> Column:
    """exp(-d2 / (2 sigma^2)) of a squared distance."""
    return F.exp(-d2 / F.lit(2.0 * sigma * sigma))


def student_t_kernel(d: Column, nu: float) -> Column:
    """(1 + d^2 / nu) ^ (-(nu + 1) / 2); nu must be positive."""
    if nu <= 0:
        raise ValueError(f"degrees of freedom must be positive, got {nu}")
    return F.pow(1.0 + d * d / F.lit(float(nu)), F.lit(-(nu + 1.0) / 2.0))


def gamma_kernel(d: Column, nu: float) -> Column:
    """The heavy-tailed kernel whose constant is 6.28 times the squared Student-t density at 0."""
    g = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)
    return F.lit(g * 6.28 * g) * F.pow(1.0 + F.greatest(d, F.lit(0.0)) / F.lit(float(nu)), F.lit(-(nu + 1.0)))


def log_ratio(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """Binary logarithm of a ratio, both sides raised by eps."""
    return F.log2((a + F.lit(eps)) / (b + F.lit(eps)))
