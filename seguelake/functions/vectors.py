"""Arithmetic on ``array<double>`` columns, kept inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def light(vecs: DataFrame, vec: str = "vec") -> DataFrame:
    """A table of vectors, marked for broadcast if its numbers take at most ``BROADCAST_BYTES``."""
    numbers = vecs.agg(F.sum(F.size(vec))).first()[0] or 0
    return F.broadcast(vecs) if 8 * numbers <= BROADCAST_BYTES else vecs


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Scaled to length 1; the outer lambda binds the length so it is computed once per row."""
    scaled = F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.try_divide(x.cast("double"), n)))
    return F.when(F.get(scaled, F.lit(0)).isNotNull() & (norm(a) > 0), F.get(scaled, F.lit(0)))


def cosine(a: Column, b: Column) -> Column:
    """Null when a side is missing, empty, of another size or of zero length."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    scale = norm(a) * norm(b)
    return F.when(usable & (scale > 0), dot(a, b) / scale)


def affinity(a: Column, b: Column) -> Column:
    """Cosine mapped to [0, 1]."""
    return _mapped(cosine(a, b))


def unit_affinity(a: Column, b: Column) -> Column:
    """``affinity`` of vectors that ``unit`` has scaled."""
    return _mapped(F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), dot(a, b)))


def _mapped(cos: Column) -> Column:
    return (F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0)) + 1.0) / 2.0


def blended(score: Column, extra: Column, weight: float) -> Column:
    """Weighted mean with ``extra``; unchanged where it is missing."""
    return F.when(extra.isNull(), score).otherwise((1.0 - weight) * score + weight * extra)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
