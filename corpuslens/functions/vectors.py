"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed from the first component on."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null if a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def truncate_renorm(vec: Column, d: int) -> Column:
    """First ``d`` components scaled to unit length; a zero vector stays, a shorter one is an error."""
    checked = F.when(F.size(vec) < d, F.raise_error(F.lit(f"vector is shorter than {d}")).cast("array<double>")).otherwise(vec.cast("array<double>"))
    cut = F.slice(checked, 1, d)
    n = norm(cut)
    return F.when(n > 0, F.transform(cut, lambda x: x / n)).otherwise(cut)
