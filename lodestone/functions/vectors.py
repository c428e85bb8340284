"""Vector columns over ARRAY<DOUBLE>: dot product, norm, cosine, normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 for empty vectors, different lengths or a zero norm."""
    length = norm(a) * norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.coalesce(F.when(usable, F.try_divide(dot(a, b), F.nullif(length, F.lit(0.0)))), F.lit(0.0))


def cosine_to(v: Column, query: list[float]) -> Column:
    """Cosine of a vector column with one query vector, whose norm is folded into the plan's constants."""
    length = sum(float(x) ** 2 for x in query) ** 0.5
    if not query or length == 0.0:
        return F.lit(0.0)
    constant = F.array(*(F.lit(float(x)) for x in query))
    score = F.try_divide(dot(v, constant), F.nullif(norm(v) * F.lit(length), F.lit(0.0)))
    return F.coalesce(F.when(F.size(v) == len(query), score), F.lit(0.0))


def l2_normalized(v: Column) -> Column:
    """The vector over its norm; a zero vector stays as it is."""
    doubles = F.transform(v, lambda x: x.cast("double"))
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.when(n == 0, doubles).otherwise(F.transform(doubles, lambda x: F.try_divide(x, n)))), 1)
