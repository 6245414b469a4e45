"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.llm.common import WORD, written

ROWS_PER_PARTITION = 200_000


def word_count(text: Column | str) -> Column:
    """Number of words between ASCII spaces; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset_of(source: Column | str, seed: int) -> Column:
    """The source's random offset in [0, 1), from its name and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(source) if isinstance(source, str) else source,
                                                          F.lit("\x00"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sources in code-point order, null last, get ``weights`` in turn and share ``share`` times all
    words. No target exceeds ``most`` times its source; what it would have had beyond that is shared by
    weight among the others, again and again. That ends at a level: target = min(most * size,
    level * weight). With sources in the order of most * size / weight, the capped ones are the first
    ones, so running sums give the level without iterating: taking a source for capped that is not
    lowers the level, so the highest one that fits is right. One row per source is sorted here.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    rows = sizes.withColumn("weight", F.get(
        cycle, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_cap = W.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_cap.rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.select(
        "*",
        F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)).alias("_caps"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0))).alias("_left"),
        (F.sum("source_size").over(whole) * F.lit(float(share))).alias("_total"))
    # The level if all before this source are capped and none from here on.
    rows = rows.withColumn("_level", (F.col("_total") - F.col("_caps")) / F.col("_left"))
    fits = F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level"))
    rows = rows.withColumn("_final", F.max(fits).over(whole))
    target = F.coalesce(F.least("_cap", F.col("_final") * F.col("weight")), F.col("_cap"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source",
        size: Column | None = None, weights: Sequence[int] = (3, 1, 2), share: float = 1.5,
        most: int = 2, seed: int = 7) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken) of every row.

    Every document of a source has the same expected copies, target / source_size, and
    the running sum of them along the source, plus one random offset, is cut at the integers: a document
    is taken once for every integer its step crosses. Along the source documents are in the order of
    size, then of a key hash, so that what is taken misses the target by about one document's
    length, not by a sum of random errors.

    The running sum is a rank. Rows without their text are range-partitioned by (source, size,
    hash), so a hot source is spread over as many partitions as it fills, and sorted; a row's rank is
    its place in its partition plus the rows of its source in the partitions before. Only one count per
    source and partition is gathered. A null text has size 0, a null source is a source of its own, a source
    without words has target 0 and nothing is taken of it. Repeated rows rank one after the other.
    Reruns agree: nothing depends on partition bounds.
    """
    size = word_count("text") if size is None else size
    slim = docs.select(
        F.col(key).alias("_key"), F.col(source).alias("_source"), size.cast("long").alias("_size"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("_h"))
    slim = written(slim, "sizes")
    n = slim.count()
    parts = max(int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                -(-n // ROWS_PER_PARTITION))
    order = [F.col("_source").asc_nulls_last(), F.col("_size"), F.col("_h"), F.col("_key")]
    placed = written(
        slim.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .select("_key", "_source", "_size", "_at"), "ordered")

    pid = F.shiftright("_at", 33)
    pieces = placed.groupBy("_source", pid.alias("_pid")).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_n"), F.sum("_size").alias("_words"))
    before = W.partitionBy("_source").orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    starts = pieces.select(
        F.col("_source").alias("_s"), F.col("_pid").alias("_p"), "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    sizes = pieces.groupBy(F.col("_source").alias("source")).agg(
        F.sum("_words").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    starts = starts.join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("source")

    rate = F.when(F.col("source_size") > 0,
                  F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rank = F.col("_at") - F.col("_first") + F.col("_before")
    crossed = lambda r: F.floor(offset_of("_source", seed) + rate * r)
    copies = F.least(crossed(rank + 1) - crossed(rank), F.lit(most)).cast("int")
    return (
        placed.withColumn("_pid", pid)
        .join(starts, (F.col("_pid") == F.col("_p")) & F.col("_source").eqNullSafe(F.col("_s")))
        .select(F.col("_key").alias(key), F.col("_source").alias("source"), F.col("_size").alias("size"),
                "source_size", "target", copies.alias("copies"))
        .withColumn("taken", F.col("size") * F.col("copies")))
