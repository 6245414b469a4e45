"""An approximate graph of nearest neighbours whose work grows with the rows, not with their square.

``neighbours.nearest`` is exact; this is for all rows of tables too large for it. Rows fall into the cells of
several tables of random hyperplanes and meet all others of their cell; then, for some rounds, the neighbours of a
row are held against each other, since they are likely neighbours themselves. Cells, neighbour lists and groups
are bounded, so a row costs about tables * cell_rows + rounds * (2 * pool) ** 2 products, however many rows there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions import mlvectors
from lexiloom.functions import vectors as vec
from lexiloom.operators.neighbours import _ids, _matrix
from lexiloom.session import cut_lineage

SPARE_BITS = 12  # hyperplanes beyond those that cells of even size would need


def _lists(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("id", kind), T.StructField("near", T.ArrayType(kind)),
                         T.StructField("score", T.ArrayType(T.DoubleType()))])


def _best_of(scores: np.ndarray, ids: np.ndarray, most: int) -> list[np.ndarray]:
    """Per row the columns of the ``most`` largest finite scores, ties to the lower id, best first."""
    out = []
    for row in scores:
        at = np.flatnonzero(row > -np.inf)
        if len(at) > most:
            floor = np.partition(row[at], len(at) - most)[len(at) - most]
            at = at[row[at] >= floor]
        out.append(at[np.lexsort((ids[at], -row[at]))][:most])
    return out


def _compared(members: pa.Table, most: int, digits: int, floors: np.ndarray | None = None) -> list[tuple]:
    """(id, near, score) of all rows of a group against each other; with floors only what reaches them."""
    ids, unit = _ids(members.column("id").combine_chunks()), _matrix(members.column("vector"))
    scores = np.round(unit @ unit.T, digits) + 0.0
    np.fill_diagonal(scores, -np.inf)
    if floors is not None:
        scores[scores < floors[:, None]] = -np.inf
    keys = members.column("id").to_pylist()
    return [(keys[i], [keys[j] for j in at], scores[i, at].tolist())
            for i, at in enumerate(_best_of(scores, ids, most)) if len(at)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _by_group(most: int, digits: int, schema: pa.Schema, floored: bool):
    """Rows sorted by group, (group, id, vector[, floor]), compared group by group."""
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, out = None, []

        def settle(group: pa.Table) -> None:
            floors = group.column("floor").to_numpy() if floored else None
            out.extend(_compared(group, most, digits, floors))

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            codes = now.column("group").combine_chunks().dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist()]
            for begin, end in zip(cuts, cuts[1:]):
                settle(now.slice(begin, end - begin))
            rest = now.slice(cuts[-1])
            while out:
                yield _batch(out[:10_000], schema)
                del out[:10_000]
        if rest is not None:
            settle(rest)
        if out:
            yield _batch(out, schema)
    return f


def _merged(found: DataFrame, most: int, kind: T.DataType, schema: pa.Schema) -> DataFrame:
    """One list per id from several, without repeats: the ``most`` best. Lists stream in the order of ids, so a task holds
    those of one batch of them."""
    def settle(lists: pa.Table, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        near, score = (lists.column(c).combine_chunks() for c in ("near", "score"))
        owner = np.repeat(codes - codes[0], near.value_lengths().to_numpy(zero_copy_only=False))
        keys, scores = near.flatten(), score.flatten().to_numpy(zero_copy_only=False)
        ids = _ids(keys)
        order = np.lexsort((-scores, ids, owner))
        order = order[np.append(True, (owner[order[1:]] != owner[order[:-1]]) | (ids[order[1:]] != ids[order[:-1]]))]
        order = order[np.lexsort((ids[order], -scores[order], owner[order]))]
        order = order[np.arange(len(order)) - np.searchsorted(owner[order], owner[order]) < most]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        ends = pa.array(np.searchsorted(owner[order], np.arange(len(first) + 1)).astype(np.int32))
        whole = [lists.column("id").combine_chunks().take(pa.array(first)), *(
            pa.ListArray.from_arrays(ends, x) for x in (keys.take(pa.array(order)), pa.array(scores[order])))]
        yield pa.record_batch([x.cast(f.type) for x, f in zip(whole, schema)], schema=schema)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            codes = now.column("id").combine_chunks().dictionary_encode().indices.to_numpy()
            cut = int(np.searchsorted(codes, codes[-1]))
            if cut:
                yield from settle(now.slice(0, cut), codes[:cut])
            rest = now.slice(cut)
        if rest is not None:
            yield from settle(rest, np.zeros(rest.num_rows, dtype=np.int64))

    return found.repartition("id").sortWithinPartitions("id").mapInArrow(f, _lists(kind))


def _cells(rows: DataFrame, size: int, tables: int, cell_rows: int, seed: int) -> DataFrame:
    """(group, id): every row's cell in every table.

    A cell is a prefix of the signs of a row's products with a table's hyperplanes through the mean. Cells that hold
    more than their share take further signs, and those that still do, such as many nearly equal rows, are cut
    by a hash of the id. So no cell has much more than twice ``cell_rows`` rows.
    """
    spark = rows.sparkSession
    level = max(0, math.ceil(math.log2(max(1, size / cell_rows))))
    bits = level + SPARE_BITS
    mean = rows.agg(vector_to_array(Summarizer.mean(mlvectors.dense("vector"))).alias("m")).first()["m"]
    planes = np.random.default_rng(seed).normal(size=(len(mean), tables * bits))
    sent = spark.sparkContext.broadcast((np.array(mean), planes))

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, p = sent.value
        weight = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                unit = _matrix(batch.column(1))
                code = (((unit - center) @ p > 0).reshape(-1, tables, bits) @ weight).reshape(-1)
                at = pa.array(np.repeat(np.arange(batch.num_rows), tables))
                yield pa.record_batch(
                    [batch.column(0).take(at), pa.array(np.tile(np.arange(tables, dtype=np.int32), batch.num_rows)), pa.array(code)],
                    names=["id", "plane", "code"])

    kind = rows.schema["id"].dataType.simpleString()
    codes = cut_lineage(rows.select("id", "vector").mapInArrow(signs, f"id {kind}, plane int, code long"))
    first = codes.withColumn("cell", F.shiftright("code", bits - level))
    extra = F.least(F.lit(SPARE_BITS), F.ceil(F.log2(F.count("*") / cell_rows))).cast("int")
    more = first.groupBy("plane", "cell").agg(F.greatest(F.lit(0), extra).alias("more"))
    finer = first.join(more, ["plane", "cell"]).withColumn("cell", F.expr(f"shiftright(code, {bits - level} - more)"))
    share = finer.groupBy("plane", "more", "cell").agg(F.ceil(F.count("*") / (2 * cell_rows)).alias("parts"))
    part = F.pmod(F.xxhash64("id", "plane"), F.col("parts"))
    return finer.join(share, ["plane", "more", "cell"]).select(
        F.concat_ws("/", "plane", "more", "cell", part).alias("group"), "id")


def neighbour_graph(
    df: DataFrame, k: int, key: str = "row_id", vector: str = "vector", tables: int = 8, cell_rows: int = 256,
    pool: int = 30, rounds: int = 2, digits: int = 9, seed: int = 42,
) -> DataFrame:
    """Per row about its k most similar other rows: query_id, neighbor_rank, neighbor_id, score.

    Scores are true cosines, rounded; what may be missing are neighbours. Compare with ``neighbours.nearest`` by
    ``recall``: it grows with ``tables``, ``cell_rows``, ``pool`` and ``rounds``, and falls in tables without structure.
    Lists of ``pool`` neighbours are kept while searching. In a round the group of a row is the row, its
    neighbours, and the rows it is a neighbour of; a row that many name is in the groups of the ``pool`` closest only.

    Of equal vectors only the k + 1 with the lowest ids are searched; the others get the k lowest of them, which are their
    nearest. Zero vectors have no direction: they get no neighbours and are none. Rows with a null key or
    vector are left out. Fewer than k rows come back where fewer exist. Reruns give equal rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = df.schema[key].dataType
    schema = to_arrow_schema(_lists(kind))
    rows = df.select(F.col(key).alias("id"), vec.as_double(vector).alias("vector")).where("id is not null").where(
        vec.is_nonzero("vector")).withColumn("way", F.transform(vec.normalize("vector"), lambda x: F.round(x, 12)))
    same = F.xxhash64("way")
    order = W.partitionBy(same, "way").orderBy("id")
    lowest = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    lowest = cut_lineage(lowest)
    searched = lowest.select("id", "vector")
    size = searched.count()
    pool = max(pool, k)
    if not size:
        none = rows.select(F.col("id").alias("query_id"), F.lit(0).alias("neighbor_rank"), F.col("id").alias("neighbor_id"),
                           F.lit(0.0).alias("score"))
        return none.where("false")

    cells = _cells(searched, size, tables, cell_rows, seed)
    placed = cells.join(searched, "id").select("group", "id", "vector").repartition("group").sortWithinPartitions("group")
    found = placed.mapInArrow(_by_group(pool, digits, schema, False), _lists(kind))
    graph = cut_lineage(_merged(found, pool, kind, schema))
    for _ in range(rounds):
        edges = graph.select("id", F.posexplode(F.arrays_zip("near", "score")).alias("_", "e")).select(
            "id", F.col("e.near").alias("near"), F.col("e.score").alias("score"))
        closest = W.partitionBy("near").orderBy(F.desc("score"), "id")
        edges = edges.withColumn("_n", F.row_number().over(closest)).where(F.col("_n") <= pool).select("id", "near")
        members = edges.select(F.col("id").alias("group"), F.col("near").alias("id")).union(
            edges.select(F.col("near").alias("group"), "id")).union(graph.select("id", "id")).distinct()
        floor = F.when(F.size("score") >= pool, F.array_min("score")).otherwise(-1.0)
        known = searched.join(graph.select("id", floor.alias("floor")), "id")
        groups = members.join(known, "id").select("group", "id", "vector", "floor").repartition("group").sortWithinPartitions("group")
        better = groups.mapInArrow(_by_group(pool, digits, schema, True), _lists(kind))
        graph = cut_lineage(_merged(graph.unionByName(better), pool, kind, schema))
    ranked = graph.select("id", F.posexplode(F.slice(F.arrays_zip("near", "score"), 1, k)).alias("r", "e")).select(
        F.col("id").alias("query_id"), (F.col("r") + 1).alias("neighbor_rank"), F.col("e.near").alias("neighbor_id"), F.col("e.score").alias("score"))
    # The copies that were not searched.
    full = lowest.groupBy(same.alias("h"), "way").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > k)
    others = rows.join(searched.select("id"), "id", "left_anti").withColumn("h", same).join(full, ["h", "way"])
    copies = others.select(F.col("id").alias("query_id"), F.posexplode(F.slice("ids", 1, k)).alias("r", "neighbor_id")).select(
        "query_id", (F.col("r") + 1).alias("neighbor_rank"), "neighbor_id", F.lit(1.0).alias("score"))
    return ranked.unionByName(copies)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the mean share of each query's exact neighbours that ``found`` names."""
    hits = exact.select("query_id", "neighbor_id").join(
        found.select("query_id", "neighbor_id", F.lit(1.0).alias("hit")), ["query_id", "neighbor_id"], "left")
    share = hits.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share"))
    return share.agg(F.count("*").alias("queries"), F.avg("share").alias("recall"))
