"""Bridges between SQL arrays and ML vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions import vectors as vec
from lexiloom.functions.text import _col

_WRAPPED = T.StructType([T.StructField("v", VectorUDT())])


def dense(c: Column | str) -> Column:
    return array_to_vector(vec.as_double(c))


def sparse(indices: Column | str, weights: Column | str, size: int | Column) -> Column:
    """Sparse ML vector from parallel arrays (indices ascending).

    SQL has no constructor for it; reading the vector type's own struct layout
    through ``from_json`` builds it inside the JVM, without Python rows.
    """
    n = F.lit(size) if isinstance(size, int) else size
    layout = F.struct(
        F.lit(0).cast("byte").alias("type"),
        n.cast("int").alias("size"),
        _col(indices).alias("indices"),
        _col(weights).alias("values"),
    )
    return F.from_json(F.to_json(F.struct(layout.alias("v"))), _WRAPPED)["v"]
