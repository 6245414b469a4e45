"""Audit and report aggregations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; missing values are left out."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), column)
    )


def value_counts_all(df: DataFrame, column: str) -> DataFrame:
    """Rows per value in value order; missing is a value of its own."""
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(column)


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Share of every value among the present ones."""
    present = df.filter(F.col(column).isNotNull())
    counts = present.groupBy(column).agg(F.count("*").alias("count"))
    return counts.select(column, (F.col("count") / present.agg(F.count("*")).scalar()).alias("share"))


def exact_percentiles(
    df: DataFrame, columns, shares, cells: int = 100, most: int = 1_000_000
) -> DataFrame:
    """(column, share, value): exact percentiles with linear interpolation, of one or more columns.

    Missing values and NaN are left out; a column without values has no row. Approximate
    percentiles of all columns cut their ranges, and one count per cell shows which few cells hold the
    wanted ranks. A cut point is a cell of its own, so a hot value needs no sorting; a cell of
    more than ``most`` rows is cut again; of the others the distinct values are sorted. A round is
    two jobs for any number of columns and fetches at most ``2 * cells`` numbers for each.
    """
    names = [columns] if isinstance(columns, str) else list(columns)
    x = F.col("x")
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in names
    ]))).filter(x.isNotNull() & ~F.isnan(x))
    marks = F.array(*[F.lit(i / cells) for i in range(1, cells)])

    def numbered(regions) -> DataFrame:
        """Values strictly inside (column, low, high), with the region's number."""
        number = F.lit(None).cast("int")
        for i, (c, low, high) in enumerate(regions):
            inside = F.col("column") == c
            inside = inside if low is None else inside & (x > low)
            inside = inside if high is None else inside & (x < high)
            number = F.when(inside, i).otherwise(number)
        return long.select(number.alias("r"), "x").filter("r IS NOT NULL")

    # What is looked for in each region: (share, part, rank within the region); None: not known yet.
    regions, wanted = [(c, None, None) for c in names], None
    known, small, sought = [], [], []
    while regions:
        rows = numbered(regions)
        cuts = {r["r"]: sorted(set(r["c"])) for r in rows.groupBy("r").agg(
            F.percentile_approx("x", marks, F.lit(50 * cells)).alias("c")).collect()}
        cut = F.array().cast("array<double>")
        for i, found in cuts.items():
            cut = F.when(F.col("r") == i, F.array(*[F.lit(v) for v in found])).otherwise(cut)
        counts = rows.withColumn("cut", cut).groupBy(
            "r", F.size(F.filter("cut", lambda m: m < x)).alias("below"),
            F.array_contains("cut", x).alias("on"),
        ).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        deeper, deeper_wanted = [], []
        for i, (c, low, high) in enumerate(regions):
            own = sorted((k for k in counts if k["r"] == i), key=lambda k: k["low"])
            if wanted is None:
                last = sum(k["n"] for k in own) - 1
                ranks = [(float(p), p * last - math.floor(p * last), rank) for p in shares
                         for rank in sorted({math.floor(p * last), math.ceil(p * last)})]
            else:
                ranks = wanted[i]
            before = 0
            for k in own:
                here = [(p, part, rank - before) for p, part, rank in ranks if 0 <= rank - before < k["n"]]
                before += k["n"]
                if not here:
                    continue
                if k["low"] == k["high"]:
                    known += [(c, p, part, k["low"]) for p, part, _ in here]
                    continue
                found, at = cuts[i], k["below"]
                cell = (c, found[at - 1] if at else low, found[at] if at < len(found) else high)
                into, ranked = (small, sought) if k["n"] <= most else (deeper, deeper_wanted)
                into.append(cell)
                ranked.append(here)
        regions, wanted = deeper, deeper_wanted

    spark = df.sparkSession
    hits = spark.createDataFrame(known, "column string, share double, part double, x double")
    if small:
        ranks = spark.createDataFrame(
            [(i, small[i][0], *w) for i, here in enumerate(sought) for w in here],
            "r int, column string, share double, part double, rank long")
        earlier = W.partitionBy("r").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
        placed = numbered(small).groupBy("r", "x").agg(F.count("*").alias("n")).withColumn(
            "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        inside = (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("n"))
        hits = hits.union(placed.join(F.broadcast(ranks), "r").filter(inside).select(*hits.columns))
    low, high = F.min("x"), F.max("x")
    between = F.when(low == high, low).otherwise(low + (high - low) * F.col("part"))
    return hits.groupBy("column", "share", "part").agg(between.alias("value")).select(
        "column", "share", "value")


def describe(df: DataFrame, columns) -> DataFrame:
    """count, mean, std, min, exact quartiles and max; one row per column.

    NaN counts as missing.
    """
    df = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns])
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[f(c).alias(f"{c}|{m}") for c in columns for m, f in measures.items()])
    basic = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{m}`").alias(m) for m in measures])
        for c in columns
    ])))
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    quartiles = exact_percentiles(df, columns, list(shares.values())).groupBy("column").agg(*[
        F.max(F.when(F.col("share") == p, F.col("value"))).alias(n) for n, p in shares.items()
    ])
    return basic.join(F.broadcast(quartiles), "column", "left").select(
        "column", "count", "mean", "std", "min", *shares, "max"
    )


def missing_values(df: DataFrame, columns=None) -> DataFrame:
    """Missing values per column, one pass."""
    names = list(columns or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in names]
    return wide.select(F.inline(F.array(*pairs)))


def distinct_keys(df: DataFrame, *columns) -> DataFrame:
    """Number of distinct values of each column."""
    return df.agg(*[F.count_distinct(c).alias(f"distinct_{c}") for c in columns])


def drop_duplicates(df: DataFrame, subset, order) -> DataFrame:
    """Keep the first row (by ``order``) of each combination of ``subset``.

    The ranking has a limit of 1, which Spark applies before the shuffle too, so
    a group of copies ships one row per task.
    """
    first = W.partitionBy(*subset).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1).drop("_n")


def group_mode(df: DataFrame, by: str, column: str, name: str) -> DataFrame:
    """Most frequent value per group (ties: smallest value), its share, and the group size."""
    counts = df.groupBy(by, column).agg(F.count("*").alias("_n"))
    best = F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))
    return counts.groupBy(by).agg(F.sum("_n").alias("size"), F.min(best).alias("_b")).select(
        by,
        "size",
        F.col("_b.v").alias(name),
        (-F.col("_b.n") / F.col("size")).alias(f"{name}_share"),
    )


def crosstab_shares(df: DataFrame, row: str, column: str, values=None) -> DataFrame:
    """Row-normalised cross table; give ``values`` to save the pass that finds them."""
    counts = df.groupBy(row, column).agg(F.count("*").alias("_n"))
    shares = counts.withColumn("_share", F.col("_n") / F.sum("_n").over(W.partitionBy(row)))
    wide = shares.groupBy(row).pivot(column, list(values) if values else None)
    return wide.agg(F.sum("_share")).na.fill(0.0)


def group_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """mean, sample and population standard deviation, and count per group."""
    return df.groupBy(by).agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.stddev_pop(value).alias("std_pop"),
        F.count(value).alias("count"),
    )


def extremes(df: DataFrame, label: str, value: str) -> DataFrame:
    """Labels with the highest and lowest value (ties: smallest label)."""
    hi = F.struct((-F.col(value)).alias("v"), F.col(label).alias("l"))
    lo = F.struct(F.col(value).alias("v"), F.col(label).alias("l"))
    return df.agg(F.min(hi).alias("h"), F.min(lo).alias("w")).select(
        F.col("h.l").alias("best"), (-F.col("h.v")).alias("best_value"),
        F.col("w.l").alias("worst"), F.col("w.v").alias("worst_value"),
    )


def lowest(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The n lowest scores, ties by key."""
    return df.orderBy(score, key).limit(n)


def rounded(df: DataFrame, columns, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
