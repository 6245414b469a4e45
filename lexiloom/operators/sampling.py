"""Repeatable sampling by key hash.

``exact`` and ``exact_per_group`` return exactly n rows per stratum without
sorting the table or putting a stratum into one task:

1. every row falls into one of 16**digits equal-sized hash buckets,
2. a counting aggregation (partial counts before the shuffle) tells for each
   bucket how many rows precede it,
3. that bucket table is broadcast (its size is bounded by the number of buckets,
   or checked when there are strata), so buckets that start at or after the n-th
   row are dropped in the scan's own stage, and only the survivors (n rows plus
   part of one bucket per stratum) are shuffled and ranked, bucket by bucket.

A stratum holding a third of the table is spread over all its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions import hashing
from lexiloom.operators.lookups import small_side

# Up to this many rows, the best rows of every partition may meet in one task.
TOP_N_LIMIT = 200


def _bucketed(df: DataFrame, key, seed, digits: int) -> DataFrame:
    key_col = F.col(key) if isinstance(key, str) else key
    return df.withColumn("_hash", hashing.seeded_hash(key_col, seed)).withColumn(
        "_bucket", F.substring("_hash", 1, digits)
    )


def _offsets(bucketed: DataFrame, by: list[str]) -> DataFrame:
    """Rows per bucket and rows in earlier buckets, per stratum."""
    counts = bucketed.groupBy(*by, "_bucket").agg(F.count("*").alias("_rows"))
    # The input of this window is the bucket table (16**digits rows a stratum), not the data.
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def _join_offsets(bucketed: DataFrame, offsets: DataFrame, by: list[str]) -> DataFrame:
    on = F.lit(True)
    # Without strata there are at most 16**digits offsets; otherwise their number is checked.
    offsets = small_side(offsets) if by else F.broadcast(offsets)
    b, o = bucketed.alias("b"), offsets.alias("o")
    for c in (*by, "_bucket"):
        on = on & F.col(f"b.{c}").eqNullSafe(F.col(f"o.{c}"))
    return b.join(o, on).select("b.*", "o._rows", "o._before")


def hash_rank(
    df: DataFrame, key, seed=42, by=(), name: str = "hash_rank", digits: int = 4
) -> DataFrame:
    """Rank 1..n of every row in hash order, per stratum, with no global sort.

    ``key`` must identify rows; equal keys would make the order ambiguous.
    """
    by = list(by)
    b = _bucketed(df, key, seed, digits)
    in_bucket = W.partitionBy(*by, "_bucket").orderBy("_hash", key)
    return (
        _join_offsets(b, _offsets(b, by), by)
        .withColumn(name, (F.row_number().over(in_bucket) + F.col("_before")).cast("long"))
        .drop("_hash", "_bucket", "_rows", "_before")
    )


def hash_cuts(df: DataFrame, key: str, ranks, seed=42, digits: int = 4) -> Column:
    """Struct (c0, c1, …) of the (hash, key) found at the given ranks in hash order.

    Only the buckets holding one of the ranks are sorted. A rank of 0 gives null.
    """
    b = _bucketed(df.select(key), key, seed, digits)
    before, last = F.col("_before"), F.col("_before") + F.col("_rows")
    holds = F.lit(False)
    for r in ranks:
        holds = holds | ((before < r) & (last >= r))
    in_bucket = W.partitionBy("_bucket").orderBy("_hash", key)
    ranked = _join_offsets(b, _offsets(b, []).filter(holds), []).withColumn(
        "_rank", F.row_number().over(in_bucket) + F.col("_before")
    )
    place = F.struct(F.col("_hash").alias("h"), F.col(key).alias("k"))
    found = ranked.agg(*[
        F.max(F.when(F.col("_rank") == r, place)).alias(f"c{i}") for i, r in enumerate(ranks)
    ])
    return found.select(F.struct(*found.columns)).scalar()


def exact_per_group(
    df: DataFrame, n: int | Column, key, by=(), seed=42, digits: int = 4
) -> DataFrame:
    """Exactly ``n`` rows of every stratum (all of them where there are fewer)."""
    by = list(by)
    limit = F.lit(n) if isinstance(n, int) else n
    b = _bucketed(df, key, seed, digits)
    in_bucket = W.partitionBy(*by, "_bucket").orderBy("_hash", key)
    return (
        _join_offsets(b, _offsets(b, by).filter(F.col("_before") < limit), by)
        .withColumn("_rank", F.row_number().over(in_bucket) + F.col("_before"))
        .filter(F.col("_rank") <= limit)
        .drop("_hash", "_bucket", "_rows", "_before", "_rank")
    )


def exact(df: DataFrame, n: int, key, seed=42) -> DataFrame:
    """Exactly ``n`` rows, uniformly; all rows when there are fewer.

    A small n is a bounded heap per partition; a large one goes by buckets, so
    that no single task has to hold the sample.
    """
    if n <= TOP_N_LIMIT:
        return df.orderBy(hashing.seeded_hash(key, seed), key).limit(n)
    return exact_per_group(df, n, key, (), seed)


def row_cap(df: DataFrame, max_rows: int | None, key, seed=42) -> DataFrame:
    """``exact`` when a cap is given, else the table itself."""
    return df if max_rows is None else exact(df, max_rows, key, seed)


def fraction(df: DataFrame, share: float | Column, *columns) -> DataFrame:
    """Keep a row when the hash of ``columns`` falls below ``share``; row-local."""
    return df.filter(hashing.keep_with_probability(hashing.record_key(*columns), share))


def keep_probability(
    df: DataFrame, by: str, target: int, oversample: float = 1.25
) -> DataFrame:
    """Per category: min(1, oversample * target / rows)."""
    return (
        df.groupBy(by)
        .agg(F.count("*").alias("total_rows"))
        .withColumn(
            "keep_prob",
            F.least(F.lit(1.0), F.lit(float(oversample * target)) / F.col("total_rows")),
        )
    )


def smallest_class_sample(df: DataFrame, cap: int, key, by: str, seed=42) -> DataFrame:
    """Balanced sample: min(cap, size of the smallest class) rows of every class."""
    smallest = df.groupBy(by).agg(F.count("*").alias("n")).agg(F.min("n").alias("n"))
    size = F.least(F.lit(cap).cast("long"), smallest.scalar())
    return exact_per_group(df, size, key, [by], seed)


def exact_after_dedup(
    df: DataFrame, n: int, by: str, key, seed=42, strict: bool = True
) -> DataFrame:
    """Exactly ``n`` rows per category, or an error naming the categories too small."""
    if strict:
        short = (
            df.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") < n).orderBy(by).limit(20)
        )
        names = [f"{r[by]} ({r['n']})" for r in short.collect()]
        if names:
            raise ValueError(f"fewer than {n} rows in: {', '.join(names)}; raise the oversampling")
    return exact_per_group(df, n, key, [by], seed)


def sampling_log(df: DataFrame, by: str, kept: str, keep_prob: str) -> DataFrame:
    """Per category: rows seen, rows kept, probability used."""
    return df.groupBy(by).agg(
        F.count("*").alias("seen"),
        F.count_if(F.col(kept)).alias("kept"),
        F.max(keep_prob).alias("keep_prob"),
    )
