"""Vector functions as columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector, and for vectors of different lengths."""
    size = norm(a) * norm(b)
    return F.when((size > 0) & (F.size(a) == F.size(b)), dot(a, b) / size)


def l2_normalize(v: Column) -> Column:
    """A zero vector stays as it is."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def one_hot(position: Column, dimension: int, batch_size: int) -> Column:
    """The stand-in embedding: 1 at (position in its batch) mod dimension, whatever the text."""
    at = position % batch_size % dimension
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda j: F.when(j == at, 1.0).otherwise(0.0).cast("float"))
