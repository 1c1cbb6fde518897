"""Vector and profile arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = ["hardness", "temperature", "weight", "formality", "era_affinity"]
NEUTRAL = 0.5


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(c: str | Column) -> Column:
    """The logistic function, which turns a reranker's raw score into a share."""
    return 1 / (1 + F.exp(-_col(c)))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two arrays; 0 when lengths differ or one is all zero."""
    a, b = _col(a), _col(b)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def profile_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Euclidean distance over the five dimensions and the register.

    Missing values count as neutral on either side.
    """
    total = F.lit(0.0)
    for dim in [*DIMENSIONS, "register"]:
        gap = F.coalesce(a[dim], F.lit(NEUTRAL)) - F.coalesce(b[dim], F.lit(NEUTRAL))
        total = total + gap * gap
    return F.sqrt(total)


def squared_gap(a: dict[str, Column], b: Column, dims: list[str]) -> Column:
    """Sum of squared gaps of values that are known on both sides."""
    total = F.lit(0.0)
    for dim in dims:
        total = total + (a[dim] - b[dim]) * (a[dim] - b[dim])
    return total


def profile_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """1 minus the mean absolute gap over the six dimensions."""
    dims = [*DIMENSIONS, "register"]
    total = F.lit(0.0)
    for dim in dims:
        total = total + F.abs(
            F.coalesce(a[dim], F.lit(NEUTRAL)) - F.coalesce(b[dim], F.lit(NEUTRAL))
        )
    return 1 - total / len(dims)


def clamp(c: str | Column, low: float, high: float) -> Column:
    return F.when(_col(c).isNotNull(), F.least(F.greatest(_col(c), F.lit(low)), F.lit(high)))


def sigmoid(c: str | Column) -> Column:
    return 1 / (1 + F.exp(-_col(c)))
