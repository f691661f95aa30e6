"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statuta.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column, epsilon: float = 0.0) -> Column:
    """v by its length; a zero vector stays as it is."""
    size = norm(v) + F.lit(epsilon)
    return let(F.when(size == 0, F.lit(1.0)).otherwise(size), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """0.0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(size == 0, F.lit(1.0)).otherwise(size))


def argmax(v: Column) -> Column:
    """0-based place of the first largest value."""
    return F.array_position(v, F.array_max(v)) - 1


def hashed_embedding(words: Column, dim: int = 32) -> Column:
    """Counts of words by a hash of each: a deterministic stand-in for a model."""
    places = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % dim)
    counts = lambda held: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(held, lambda p: p == i)).cast("double"))
    return let(places, counts)
