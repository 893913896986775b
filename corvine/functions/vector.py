"""Vector expressions on arrays; computed in double precision, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Null where a component is missing or the widths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """In -1..1; 0 where one vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def similarity01(a: Column | str, b: Column | str) -> Column:
    """The cosine moved to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine(a, b) + 1) / 2))


def distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def normalised(a: Column | str) -> Column:
    """Of length 1; a zero vector stays."""
    length = norm(a)
    return F.transform(a, lambda x: F.when(length == 0, 0.0).otherwise(x.cast("double") / length))


def similarity_level(s: Column) -> Column:
    """Steps from a similarity to a confidence."""
    steps = F.when(s >= 0.9, 0.95).when(s >= 0.8, 0.85).when(s >= 0.7, 0.75).when(s >= 0.6, 0.65).when(s >= 0.5, 0.55)
    return steps.otherwise(F.greatest(F.lit(0.1), 0.8 * s))


def combined(similarity: Column, keyword: Column, weight: float = 0.7) -> Column:
    return weight * similarity + (1 - weight) * keyword


def confidence(similarity: Column, keyword: Column, quality: Column | float = 1.0, variance: Column | float = 0.0) -> Column:
    """Combined score, agreement and context, less variance; in 0..1."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    raw = combined(similarity, keyword) + 0.15 * F.least(similarity, keyword) + 0.1 * c(quality) - 0.2 * c(variance)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def quality_word(score: Column) -> Column:
    return F.when(score >= 0.9, "excellent").when(score >= 0.7, "good").when(score >= 0.5, "moderate").otherwise("weak")

