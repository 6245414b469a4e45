"""Neighbour graph and threshold join against the exact forms and brute force."""

import collections

import numpy as np
import pytest

from lexiloom.operators import latent_space, neighbour_graph, neighbours, similarity_join

SCHEMA = "row_id long, vector array<double>, label int"


def clustered(n, dims, centres, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(centres, dims))
    which = rng.integers(centres, size=n)
    return centre[which] + 0.4 * rng.normal(size=(n, dims)), which


def table(spark, m, labels=None, first=0):
    labels = labels if labels is not None else np.zeros(len(m), int)
    return spark.createDataFrame([(first + i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(m, labels))], SCHEMA)


def test_graph_finds_most_neighbours_with_less_work(spark):
    m, labels = clustered(1500, 24, 30)
    df = table(spark, m, labels).cache()
    graph = neighbour_graph.neighbour_graph(df, 10, cell_rows=64, tables=4, pool=20, rounds=2).cache()
    exact = neighbours.nearest(df, df, 10).cache()
    found = neighbour_graph.recall(graph, exact).first()
    assert found.queries == 1500 and found.recall >= 0.9
    rough = neighbour_graph.neighbour_graph(df, 10, cell_rows=64, tables=1, pool=20, rounds=0)
    assert neighbour_graph.recall(rough, exact).first().recall < found.recall
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    per = collections.defaultdict(list)
    for r in graph.collect():
        assert r.score == pytest.approx(unit[r.query_id] @ unit[r.neighbor_id], abs=2e-9) and r.query_id != r.neighbor_id
        per[r.query_id].append((r.neighbor_rank, -r.score, r.neighbor_id))
    for rows in per.values():
        rows.sort()
        assert [x[0] for x in rows] == list(range(1, 11)) and sorted(x[1:] for x in rows) == [x[1:] for x in rows]
    again = neighbour_graph.neighbour_graph(df.repartition(5), 10, cell_rows=64, tables=4, pool=20, rounds=2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, graph.collect()))
    close = latent_space.row_purity(df, "row_id", ["label"], ranked=graph).agg({"purity_label": "avg"}).first()[0]
    assert close == pytest.approx(latent_space.row_purity(df, "row_id", ["label"]).agg({"purity_label": "avg"}).first()[0], abs=0.02)


def test_graph_of_copies_zeros_nulls_and_few_rows(spark):
    m, _ = clustered(60, 8, 4)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(m)] + [(100 + i, (2.0 * m[0]).tolist(), 0) for i in range(40)]
    rows += [(500, [0.0] * 8, 0), (501, None, 0), (None, m[3].tolist(), 0)]
    out = collections.defaultdict(list)
    for r in neighbour_graph.neighbour_graph(spark.createDataFrame(rows, SCHEMA), 5, cell_rows=16, rounds=1).collect():
        out[r.query_id].append((r.neighbor_rank, r.neighbor_id, r.score))
    assert set(out) == {*range(60), *range(100, 140)} and all(len(v) == 5 for v in out.values())
    assert sorted(out[139]) == [(1, 0, 1.0), *((i, 98 + i, 1.0) for i in range(2, 6))]
    assert sorted(out[0]) == [(i + 1, 100 + i, 1.0) for i in range(5)]
    two = spark.createDataFrame(rows[:2], SCHEMA)
    assert {(r.query_id, r.neighbor_id) for r in neighbour_graph.neighbour_graph(two, 5).collect()} == {(0, 1), (1, 0)}
    assert neighbour_graph.neighbour_graph(two.limit(0), 5).count() == 0
    named = two.selectExpr("concat('n', row_id) AS name", "vector")
    assert {(r.query_id, r.neighbor_id) for r in neighbour_graph.neighbour_graph(named, 5, "name").collect()} == {("n0", "n1"), ("n1", "n0")}


@pytest.mark.parametrize("block_rows", [25, 100_000])
@pytest.mark.parametrize("least", [0.5, 0.95, 1.0])
def test_threshold_join_equals_brute_force(spark, least, block_rows):
    m, _ = clustered(220, 12, 8)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(m)] + [(1000 + i, (3.0 * m[i % 4]).tolist(), 0) for i in range(50)] + [(2000, [0.0] * 12, 0), (2001, [0.0] * 12, 0)]
    df = spark.createDataFrame(rows + [(None, m[0].tolist(), 0), (3000, None, 0)], SCHEMA)
    ids, all_ = [r[0] for r in rows], np.array([r[1] for r in rows])
    norm = np.linalg.norm(all_, axis=1, keepdims=True)
    unit = np.divide(all_, norm, out=np.zeros_like(all_), where=norm > 0)
    links = np.round(unit @ unit.T, 9) >= least
    np.fill_diagonal(links, False)
    out = {r.row_id: (r.class_id, r.n_links) for r in similarity_join.similar_rows(df, least, block_rows=block_rows).collect()}
    assert out == {i: (int(i - 1000) % 4 if 1000 <= i < 2000 else i, int(links[n].sum())) for n, i in enumerate(ids)}
    classes, pairs = similarity_join.class_links(df, least, block_rows=block_rows)
    found = sorted((r.class_a, r.class_b) for r in pairs.collect())
    assert found == sorted({(ids[a], ids[b]) for a, b in zip(*np.nonzero(links)) if ids[a] < ids[b] < 1000})
    assert similarity_join.similar_rows(df.limit(0), least).count() == 0


def test_prefix_bounds_spare_full_products():
    m, _ = clustered(600, 40, 20)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    i, j, cosine, full = similarity_join.surviving_pairs(unit, unit, 0.9, 16)
    a, b = np.nonzero(unit @ unit.T >= 0.9)
    assert sorted(zip(i, j)) == sorted(zip(a, b)) and full < 0.3 * 600 * 600
    with pytest.raises(ValueError):
        similarity_join.class_links(None, 0.0)
