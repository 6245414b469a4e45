"""Connected components of an edge table, as alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import written


def _pull_to_smallest(pairs: DataFrame, only_larger: bool) -> DataFrame:
    """Of every node's neighbours in (a, b), link each to the smallest one.

    The smallest neighbour comes from an aggregation with partial sums, and goes back by a plain join
    that may be split, so a hub with a third of all edges stays spread over many tasks.
    """
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    if only_larger:
        least = least.select("a", F.least("a", "m").alias("m"))
    joined = pairs.join(least, "a")
    if only_larger:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.select(F.explode(F.array(
        F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
        F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
    )).alias("e")).select("e.*")


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges.

    Edges with a null end and loops say nothing and are passed over; nodes that have no other
    edge are absent, and no edges at all give an empty table. Repeated edges count once. Large-star
    and small-star steps alternate until the edges stay as they are, which takes a number of
    rounds that grows with the logarithm of the longest chain. Each round is two aggregations and
    two joins over at most as many edges as there were, written to the shared folder.
    """
    pairs = written(
        edges.where(f"{left} is not null and {right} is not null and {left} <> {right}")
        .select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .distinct(), "edges")
    print_of = lambda df: tuple(df.agg(
        F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = print_of(pairs)
    if not before[0]:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        both = pairs.select("a", "b").union(pairs.select("b", "a"))
        large = _pull_to_smallest(both, True).where("a <> b").distinct()
        small = _pull_to_smallest(large, False).where("a <> b").distinct()
        pairs = written(small, "edges")
        after = print_of(pairs)
        if after == before:
            break
        before = after
    members = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(members.select("component", "component").distinct())
