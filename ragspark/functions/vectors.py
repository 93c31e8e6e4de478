"""Vector expressions over ``array<float>``: double inside, float32 at the end."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_norm(v: Column) -> Column:
    return _sum(F.transform(v, lambda x: x.cast("double") * x.cast("double")))


def all_finite(v: Column) -> Column:
    inf = F.lit(float("inf")).cast("double")
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < inf))


def is_valid(v: Column, dimensions: int) -> Column:
    """Exact dimension and every component finite; null vectors are not valid."""
    return F.coalesce((F.size(v) == dimensions) & all_finite(v), F.lit(False))


def is_complete(v: Column, dimensions: int) -> Column:
    """The stored-vector length test of the catalog: present and of full length."""
    return F.coalesce(F.size(v) == dimensions, F.lit(False))


def clamp_score(score: Column) -> Column:
    return F.greatest(F.lit(-1.0).cast("float"), F.least(F.lit(1.0).cast("float"), score.cast("float")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine as float32 in [-1, 1]; -1 for zero, non-finite or mismatched vectors."""
    norm = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    usable = (F.size(a) == F.size(b)) & all_finite(a) & all_finite(b) & (norm > 0)
    return F.when(
        F.coalesce(usable, F.lit(False)), clamp_score(F.try_divide(dot(a, b), norm))
    ).otherwise(F.lit(-1.0).cast("float"))


def cosine_to(v: Column, query: list[float]) -> Column:
    """Cosine against one literal vector, whose norm is folded once at plan time."""
    values = [float(x) for x in query]
    q_norm = math.sqrt(sum(x * x for x in values))
    if q_norm == 0 or not math.isfinite(q_norm):
        return F.lit(-1.0).cast("float")
    literal = F.array(*[F.lit(x) for x in values])
    norm = F.sqrt(squared_norm(v)) * F.lit(q_norm)
    usable = F.coalesce(is_valid(v, len(values)) & (norm > 0), F.lit(False))
    return F.when(usable, clamp_score(F.try_divide(dot(v, literal), norm))).otherwise(F.lit(-1.0).cast("float"))


def l2_normalise(v: Column, epsilon: float = 1e-12) -> Column:
    """Unit vector as ``array<float>``; null when the norm is not finite or not above ``epsilon``."""
    def unit(norm: Column) -> Column:
        ok = (norm > epsilon) & (norm < F.lit(float("inf")))
        return F.when(ok, F.transform(v, lambda x: F.try_divide(x.cast("double"), norm).cast("float")))

    # the lambda binds the norm, which would be summed again for every component
    return F.transform(F.array(F.sqrt(squared_norm(v))), unit)[0]


def active_tokens(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda m: m == 1))
