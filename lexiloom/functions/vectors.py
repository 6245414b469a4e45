"""Dense vector expressions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.text import _col


def as_double(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(v: Column | str) -> Column:
    """Unit length; the zero vector stays zero. The norm is computed once per row."""
    return F.transform(
        F.arrays_zip(
            as_double(v).alias("x"),
            F.array_repeat(norm(v), F.size(_col(v))).alias("n"),
        ),
        lambda s: F.when(s["n"] == 0, 0.0).otherwise(s["x"] / s["n"]),
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors, 0 when either is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale)


def is_nonzero(v: Column | str) -> Column:
    return F.exists(_col(v), lambda x: x != 0)
