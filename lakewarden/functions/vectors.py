"""Vector expressions over ``array<float|double>`` columns, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lakewarden.functions.bind import bind


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    """Inner product of two double arrays, summed left to right."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(vector: Column) -> Column:
    """L2-normalise; a zero vector is divided by 1 and stays zero. The norm is computed once, not once an element."""
    return bind(norm(vector), lambda size: F.transform(vector, lambda x: x / F.when(size == 0, F.lit(1.0)).otherwise(size)))
