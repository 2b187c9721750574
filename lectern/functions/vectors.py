"""Column expressions over vectors, computed in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def invalid_reason(vector: Column, dimensions: int) -> Column:
    """Why a vector can't be used; null if it can."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return (
        F.when(vector.isNull() | (F.size(vector) == 0), F.lit("empty"))
        .when(F.size(vector) != dimensions, F.lit("dimension"))
        .when(~finite, F.lit("not finite"))
        .when(F.forall(vector, lambda x: x == 0), F.lit("zero"))
    )


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, as lambdas would compute it for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def unit(vector: Column) -> Column:
    """L2-normalised; scaled by its largest component first, so that squares don't overflow."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    scaled = let(F.array_max(F.transform(wide, F.abs)), lambda top: F.transform(wide, lambda x: F.try_divide(x, top)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return let(scaled, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.try_divide(x, n))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(unit_a: Column, unit_b: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(unit_a, unit_b)))
