"""Blocks: their number stays bounded while rows grow, and their size within what a task holds."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexiloom.operators import neighbours, similarity_join


def test_rows_of_blocks_bound_the_copies_of_a_row():
    assert neighbours.rows_of_blocks(1000, 300, 65_536) == 300
    for rows in (120_000, 500_000):
        assert -(-rows // neighbours.rows_of_blocks(rows, 200, 65_536)) <= neighbours.MOST_BLOCKS
    assert neighbours.rows_of_blocks(10**9, 200, 65_536) == 65_536


def test_dense_join_ships_a_row_to_few_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)))], "row_id long, vector array<double>")
    asked = []
    pairs = neighbours._cell_pairs
    monkeypatch.setattr(neighbours, "_cell_pairs", lambda *a: asked.append(pairs(*a)) or asked[-1])
    many = neighbours.nearest(df, df, 3, broadcast_queries=0, block_rows=5).collect()
    # Cells are at most MOST_BLOCKS, and their rounding up adds at most as many blocks again.
    assert sum(q * c for _, _, q, c, *_ in asked[0]) <= (2 * neighbours.MOST_BLOCKS) ** 2
    assert sorted(many) == sorted(neighbours.nearest(df, df, 3).collect())


def test_sparse_blocks_score_alike_by_matrix_and_by_postings(monkeypatch):
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(40, size=rng.integers(0, 12), replace=False)) for _ in range(500)]
    weights = [rng.random(len(r)) / 4 for r in rows]
    table = pa.table([pa.array(range(500)), pa.array(range(500)), pa.array(rows, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64()))],
                     names=["query_id", "neighbor_id", "indices", "weights"])
    opts = {"k": 4, "digits": 9, "exclude_self": True}
    best = []
    for most in (neighbours.MATRIX_TERMS, 0):
        monkeypatch.setattr(neighbours, "MATRIX_TERMS", most)
        found, _ = neighbours._score_sparse_block(table, table, opts, np.zeros(500))
        best.append(sorted(zip(*(np.concatenate(x).tolist() for x in zip(*found)))))
    assert best[0] == best[1] and len(best[0]) > 1500


def test_links_are_counted_where_they_are_found(spark):
    rng = np.random.default_rng(6)
    near = np.ones(6) + 0.01 * rng.normal(size=(300, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)], "row_id long, vector array<double>")
    schema = "class_id {id}, met long, links long"

    def meet(guest, home, same):
        links = sum(len(i) for i, _, _ in similarity_join._reached(guest, home, 0.9, 9, 16))
        return pa.table([home.column("class_id").slice(0, 1), pa.array([1]), pa.array([links])], names=["class_id", "met", "links"])

    _, met = similarity_join._meetings(df, 0.9, "row_id", "vector", 9, 3, meet, schema)
    asked = met.agg(F.sum("met"), F.sum("links")).first()
    assert asked[0] <= (2 * neighbours.MOST_BLOCKS) ** 2 and asked[1] >= 300 * 299 // 2
    _, counted = similarity_join.class_link_counts(df, 0.9, block_rows=3)
    assert {r.linked for r in counted.collect()} == {299} and counted.count() == 300
    _, links = similarity_join.class_links(df, 0.9, block_rows=3)
    assert links.count() == links.where("class_a < class_b").distinct().count() == 300 * 299 // 2
