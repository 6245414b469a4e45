"""Row identity and positional alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.sampling import hash_rank


def with_row_id(df: DataFrame, key, seed=42, name: str = "row_id") -> DataFrame:
    """Dense ids 0..n-1 that depend on the data only, not on its layout."""
    return hash_rank(df, key, seed, name="_rank").withColumn(name, F.col("_rank") - 1).drop("_rank")


def align(vectors: DataFrame, labels: DataFrame, key: str = "row_id") -> DataFrame:
    """Vectors with their labels, by row id."""
    return vectors.join(labels, key)


def alignment_report(vectors: DataFrame, labels: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows matched and rows missing on either side; all is well when both are 0."""
    v = vectors.select(key).withColumn("_v", F.lit(1))
    m = labels.select(key).withColumn("_m", F.lit(1))
    both = v.join(m, key, "full_outer")
    return both.agg(
        F.count_if(F.col("_v").isNotNull() & F.col("_m").isNotNull()).alias("matched"),
        F.count_if(F.col("_v").isNull()).alias("without_vector"),
        F.count_if(F.col("_m").isNull()).alias("without_label"),
    )
