"""Vector arithmetic on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamsift.functions.text import let


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """The plain dot product: the cosine of unit vectors."""
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(_double(v), lambda x: x * x)))


def normalize(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    return let(_double(v), lambda d: let(norm(d), lambda n: F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b)


def mock_embedding(text: Column, dim: int = 64) -> Column:
    """A unit vector that depends on nothing but the text: equal texts, equal vectors."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.xxhash64(text, i) / F.lit(float(2**63)))
    return normalize(raw)
