"""Vector arithmetic on ARRAY<FLOAT> columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column, eps: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda x: x.cast("double") / n)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str) -> Column:
    """Larger is better: the inner product, or the squared distance negated."""
    return dot(a, b) if metric == "ip" else -squared_distance(a, b)


def mean_pool(token_vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors where the mask is 1; the sum of the mask counts as 1e-9 at least."""
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, x: s + x.cast("double")), F.lit(1e-9))
    masked = F.zip_with(token_vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m.cast("double")))
    zero = F.transform(F.element_at(token_vectors, 1), lambda x: F.lit(0.0))
    total = F.aggregate(masked, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / weight)


def first_pool(token_vectors: Column) -> Column:
    return F.element_at(token_vectors, 1)
