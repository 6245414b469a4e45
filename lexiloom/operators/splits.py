"""Leakage-free train, validation and test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import hashing
from lexiloom.operators.sampling import hash_cuts
from lexiloom.session import cut_lineage


def by_group(
    df: DataFrame,
    group: str = "parent_asin",
    test: float = 0.15,
    val: float = 0.15,
    seed=42,
    row_key: str | None = None,
    name: str = "split",
) -> DataFrame:
    """Add a split column; all rows of a group get the same split.

    A row-local expression: no shuffle, however large a group is, and it also
    runs on a stream. Shares are shares of groups and hold in expectation; see
    ``by_group_exact`` for exact numbers of groups. Without the group column the
    rows themselves are split by ``row_key``.
    """
    key = group if group in df.columns else row_key
    if key is None:
        raise ValueError(f"no column '{group}' to split by and no row key given")
    u = hashing.unit_interval(hashing.seeded_hash(key, seed))
    return df.withColumn(
        name, F.when(u < test, "test").when(u < test + val, "val").otherwise("train")
    )


def by_group_exact(
    df: DataFrame, group: str = "parent_asin", test: float = 0.15, val: float = 0.15, seed=42,
    name: str = "split",
) -> DataFrame:
    """Add a split column with an exact number of groups per split.

    ceil(test * groups) groups go to test, then ceil(val / (1 - test) * rest) to
    val. In hash order of the distinct groups that makes two cut points, and with
    those labelling a row is row-local: no join, however large a group is.
    """
    # Stored: the three aggregations below would each read, and clean, all rows again.
    groups = cut_lineage(df.select(group).distinct())
    total = groups.agg(F.count("*")).scalar()
    n_test = F.ceil(F.lit(test) * total)
    n_val = F.ceil(F.lit(val / (1.0 - test)) * (total - n_test))

    cuts = hash_cuts(groups, group, [n_test, n_test + n_val], seed)
    at = F.struct(hashing.seeded_hash(group, seed).alias("h"), F.col(group).alias("k"))
    return df.withColumn(
        name,
        F.when(at <= cuts["c0"], "test").when(at <= cuts["c1"], "val").otherwise("train"),
    )


def leaked_groups(df: DataFrame, group: str = "parent_asin", split: str = "split") -> DataFrame:
    """Groups found in more than one split; empty when there is no leakage."""
    return (
        df.groupBy(group)
        .agg(
            F.count_distinct(split).alias("splits"),
            F.count("*").alias("rows"),
        )
        .filter(F.col("splits") > 1)
    )


def shared_groups(df: DataFrame, a: str, b: str, group: str = "parent_asin") -> DataFrame:
    """Keys occurring in both splits ``a`` and ``b``."""
    def keys(s: str) -> DataFrame:
        return df.filter(F.col("split") == s).select(group)

    return keys(a).intersect(keys(b))
