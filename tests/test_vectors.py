import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import vectors as vec
from lexiloom.operators import latent_space, neighbours, pooling, shaping
from lexiloom.operators import vocabulary as vb


def brute(queries, corpus, k, exclude_self=True, drop_exact=False):
    """(query, rank, neighbour, score) by comparing everything with everything."""
    def unit(v):
        v = np.asarray(v, dtype=float)
        n = np.sqrt((v * v).sum())
        return v / n if n > 0 else v

    out = []
    for qi, qv in queries:
        scored = []
        for ci, cv in corpus:
            s = float(np.round(unit(qv) @ unit(cv), 9) + 0.0)
            if (exclude_self and qi == ci) or (drop_exact and s >= 1.0):
                continue
            scored.append((-s, ci))
        for rank, (s, ci) in enumerate(sorted(scored)[:k], 1):
            out.append((qi, rank, ci, -s + 0.0))
    return sorted(out)


@pytest.fixture(scope="module")
def points():
    """Clusters, a third exact copies, zero vectors, and random points."""
    rng = np.random.default_rng(1)
    out, copy = [], rng.integers(-3, 4, 6).astype(float)
    centres = rng.standard_normal((4, 6)) * 5
    for i in range(240):
        if i % 3 == 0:
            v = copy
        elif i % 40 == 1:
            v = np.zeros(6)
        elif i % 5 == 0:
            v = rng.standard_normal(6)
        else:
            v = centres[i % 4] + rng.standard_normal(6) * 0.1
        out.append((i, [float(x) for x in v]))
    return out


@pytest.fixture(scope="module")
def frame(spark, points):
    return spark.createDataFrame(points, "row_id long, vector array<double>").withColumn(
        "label", F.col("row_id") % 4)


def found(df):
    return sorted((r["query_id"], r["neighbor_rank"], r["neighbor_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"exclude_self": False}, {"drop_exact": True}])
@pytest.mark.parametrize("form", [{}, {"broadcast_queries": 0, "block_rows": 30},
                                  {"broadcast_queries": 0, "block_rows": 10_000}])
def test_nearest_equals_brute_force(frame, points, options, form):
    got = found(neighbours.nearest(frame, frame, 7, **options, **form))
    want = brute(points, points, 7, **options)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-9)


def test_partitioned_form_prunes_far_cells():
    """Three distant tight groups: a cell only needs its own candidates."""
    pivots = np.eye(3)
    stats = {i: {"rows": 1000, "reach": 0.05} for i in range(3)}
    pairs = neighbours._cell_pairs(stats, stats, pivots, 10, 500)
    assert sorted((p[0], p[1]) for p in pairs) == [(0, 0), (1, 1), (2, 2)]
    assert {(p[2], p[3]) for p in pairs} == {(2, 2)}


def test_nearest_with_more_neighbours_than_rows(frame, points):
    few = frame.filter("row_id < 4")
    assert found(neighbours.nearest(few, few, 10)) == brute(points[:4], points[:4], 10)
    none = frame.limit(0)
    assert neighbours.nearest(none, few, 3).count() == 0
    assert neighbours.nearest(few, none, 3).count() == 0
    assert neighbours.nearest(few, none, 3, broadcast_queries=0).count() == 0


def test_string_ids_and_payload(spark):
    df = spark.createDataFrame(
        [("b", [1.0, 0.0], "x"), ("a", [1.0, 0.0], "y"), ("c", [0.0, 1.0], "z")],
        "id string, vector array<double>, tag string",
    )
    for form in ({}, {"broadcast_queries": 0}):
        got = neighbours.nearest(df, df, 1, "id", "id", payload=["tag"], **form).collect()
        assert {r["query_id"]: (r["neighbor_id"], r["tag"]) for r in got} == {
            "a": ("b", "x"), "b": ("a", "y"), "c": ("a", "y")}


def test_sparse_equals_dense(spark, frame, points):
    kept = frame.filter(vec.is_nonzero("vector"))
    unit = kept.withColumn("vector", vec.normalize("vector"))
    pairs = F.filter(
        F.transform("vector", lambda x, i: F.struct(i.alias("i"), x.alias("w"))), lambda p: p["w"] != 0)
    sparse = unit.select(
        "row_id", F.transform(pairs, lambda p: p["i"]).alias("indices"),
        F.transform(pairs, lambda p: p["w"]).alias("weights"))
    a = found(neighbours.nearest_sparse(sparse, sparse, 5))
    b = found(neighbours.nearest(kept, kept, 5))
    assert [x[:3] for x in a] == [x[:3] for x in b]
    # These have negative weights, for which blocks have no bounds.
    with pytest.raises(Exception, match="negative"):
        neighbours.nearest_sparse(sparse, sparse, 5, broadcast_queries=3).count()


def sparse_frame(spark, n, seed, terms=60, empty=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        size = int(rng.integers(1, 9))
        idx = sorted(set((rng.zipf(1.4, size) % terms).tolist()))
        w = rng.random(len(idx)) + 0.05
        rows.append((i, [int(x) for x in idx], (w / np.linalg.norm(w)).tolist(), f"p{i}"))
    rows += [(n + i, [], [], "empty") for i in range(empty)]
    return spark.createDataFrame(rows, "row_id long, indices array<int>, weights array<double>, tag string")


@pytest.mark.parametrize("block_rows", [7, 40, 10_000])
def test_sparse_blocks_equal_the_broadcast_form(spark, block_rows):
    corpus = sparse_frame(spark, 300, 1, empty=3)
    copies = corpus.where("row_id < 30").selectExpr("row_id + 1000 AS row_id", "indices", "weights", "tag")
    lonely = spark.createDataFrame([(5000, [9999], [1.0], "own term"), (5001, [], [], "empty")], corpus.schema)
    corpus = corpus.union(copies)
    queries = corpus.where("row_id % 3 = 0").union(lonely)
    forms = [sorted(map(tuple, neighbours.nearest_sparse(queries, corpus, 6, payload=["tag"], exclude_self=own, **form).collect()))
             for own in (True, False) for form in ({}, {"broadcast_queries": 0, "block_rows": block_rows})]
    assert forms[0] == forms[1] and forms[2] == forms[3] and len(forms[0]) == 6 * queries.count()
    assert neighbours.nearest_sparse(queries.limit(0), corpus, 6, broadcast_queries=0).count() == 0
    assert neighbours.nearest_sparse(queries, corpus.limit(0), 6, broadcast_queries=0).count() == 0


def test_sub_blocks_are_passed_over(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [i // 50], [1.0]) for i in range(1000)] + [(1000 + i, [int(rng.integers(20)), 30], [0.9, 0.1]) for i in range(200)]
    table = pa.table([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))],
                     names=["neighbor_id", "indices", "weights"])
    queries = table.rename_columns(["query_id", "indices", "weights"])
    found, made = neighbours._score_sparse_block(queries, table, {"k": 5, "digits": 9, "exclude_self": True}, np.zeros(len(rows)))
    assert sum(len(x[0]) for x in found) == 5 * len(rows) and made < 0.4 * len(rows) ** 2


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(
        vec.norm("a").alias("n"), vec.normalize("a").alias("u"), vec.normalize("z").alias("zu"),
        vec.cosine("a", "z").alias("c"), vec.cosine("a", "a").alias("one"),
    ).collect()[0]
    assert (r["n"], r["u"], r["zu"], r["c"]) == (5.0, [0.6, 0.8], [0.0, 0.0], 0.0)
    assert r["one"] == pytest.approx(1.0)


def test_mean_pool(spark):
    docs = spark.createDataFrame(
        [(1, ["a", "a", "b"]), (2, ["x"]), (3, []), (4, ["a", "x"]), (5, None)],
        "row_id long, tokens array<string>")
    words = spark.createDataFrame(
        [("a", [1.0, 2.0]), ("b", [4.0, 5.0])], "word string, vector array<double>")
    want = {1: [2.0, 3.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [1.0, 2.0], 5: [0.0, 0.0]}
    for max_bytes in (1 << 20, 0):  # broadcast, then by join
        got = pooling.mean_pool(docs, words, 2, max_bytes=max_bytes)
        assert {r["row_id"]: r["vector"] for r in got.collect()} == want
        row = pooling.coverage(got).collect()[0]
        assert (row["rows"], row["nonzero_rows"], row["coverage"]) == (5, 2, 0.4)
    assert pooling.coverage(got.limit(0)).collect()[0]["coverage"] == 0.0
    assert shaping.drop_zero_vectors(got).count() == 2


def test_purity(spark):
    rows = [(i, [1.0, 0.01 * i], "a") for i in range(4)] + [(i, [0.01 * i, 1.0], "b") for i in range(4, 9)]
    df = spark.createDataFrame(rows, "row_id long, vector array<double>, label string")
    per = {r["class"]: (r["mean"], r["std"], r["n"]) for r in
           latent_space.neighbourhood_purity(df, "row_id", "label", 3).collect()}
    assert per == {"a": (1.0, 0.0, 4), "b": (1.0, 0.0, 5)}
    capped = latent_space.neighbourhood_purity(df, "row_id", "label", 5, query_limit=2)
    by = {r["class"]: r for r in capped.collect()}
    assert by["a"]["n"] == 2 and by["a"]["mean"] == pytest.approx(0.6)
    assert 0 <= latent_space.mean_purity(capped).collect()[0]["mean_purity"] <= 1


def test_centroids_and_closest_pair(spark):
    df = spark.createDataFrame(
        [("a", [2.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 1.0]), ("c", [-1.0, 0.0])],
        "label string, vector array<double>")
    raw = {(r["label_a"], r["label_b"]): r["cosine"] for r in
           latent_space.centroid_similarity(df, "label").collect()}
    assert raw["a", "b"] == pytest.approx(1.5 / np.sqrt(1.25 * 2)) and raw["a", "a"] == 1.0
    unit = latent_space.centroid_similarity(df, "label", normalize=True)
    pair = latent_space.most_similar_pair(unit, "label").collect()[0]
    assert tuple(pair) == ("a", "b", 1.0)
    wide = latent_space.similarity_matrix(unit, "label")
    assert wide.columns == ["label_a", "a", "b", "c"] and wide.count() == 3
    with pytest.raises(ValueError, match="nearest"):
        latent_space.pairwise_cosine(df, "label", "vector", max_rows=2)


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame(
        [(1, "red red car"), (2, "red bus"), (3, "bus stop"), (4, "")], "doc_id long, cleaned_text string")
    st = vb.TermSettings(max_features=None, min_df=2, max_df=0.95, low=1, high=1)
    got = {(r["doc_id"], r["term"]): r["weight"] for r in vb.tfidf(docs, "doc_id", settings=st).collect()}
    assert set(got) == {(1, "red"), (2, "red"), (2, "bus"), (3, "bus")}
    assert got[1, "red"] == 1.0 and got[2, "red"] == pytest.approx(np.sqrt(0.5))
    fitted = {r["term"]: (r["df"], r["cf"], r["idf"]) for r in vb.fit_vocabulary(docs, settings=st).collect()}
    assert fitted["red"] == (2, 3, pytest.approx(np.log(5 / 3) + 1))
    capped = vb.TermSettings(max_features=1, min_df=1, low=1, high=1)
    assert [r["term"] for r in vb.fit_vocabulary(docs, settings=capped).collect()] == ["red"]
    common = vb.TermSettings(min_df=1, max_df=0.4, low=1, high=1)
    assert {r["term"] for r in vb.fit_vocabulary(docs, settings=common).collect()} == {"car", "stop"}


def test_cluster_terms_count_absent_documents(spark):
    docs = spark.createDataFrame(
        [(1, "x", "apple"), (2, "x", "apple"), (3, "y", "pear"), (4, "y", "")],
        "doc_id long, cluster string, cleaned_text string")
    st = vb.TermSettings(min_df=1, max_df=1.0, low=1, high=1)
    got = vb.cluster_terms(docs, "doc_id", "cluster", settings=st, top_n=2).collect()
    lifts = {(r["cluster"], r["term"]): r["lift"] for r in got}
    assert lifts == {("x", "apple"): 0.5, ("x", "pear"): -0.25, ("y", "pear"): 0.25, ("y", "apple"): -0.5}
    names = vb.joined_terms(vb.cluster_terms(docs, "doc_id", "cluster", settings=st, top_n=2), "cluster")
    assert {r["cluster"]: r["top_terms"] for r in names.collect()} == {"x": "apple, pear", "y": "pear, apple"}


def test_frequent_terms_as_a_matrix_give_the_same_neighbours(spark, monkeypatch):
    import numpy as np

    from lexiloom.operators import neighbours

    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        terms = np.flatnonzero(rng.random(120) < np.linspace(0.6, 0.01, 120))
        weights = rng.random(len(terms)) if i % 50 else np.zeros(len(terms))
        rows.append((i, [int(t) for t in terms], [float(w) for w in weights]))
    df = spark.createDataFrame(rows, "row_id long, indices array<int>, weights array<double>")

    def found():
        return sorted(tuple(r) for r in neighbours.nearest_sparse(df.limit(90), df, 5).collect())

    matrices = []
    entries = neighbours._as_matrix
    monkeypatch.setattr(neighbours, "_as_matrix", lambda *a: matrices.append(len(a[2])) or entries(*a))
    mixed = found()
    assert 10 < matrices[0] < 120 and len(mixed) == 450
    for terms in (0, 3, 1000):
        monkeypatch.setattr(neighbours, "FREQUENT_TERMS", terms)
        assert found() == mixed
    monkeypatch.setattr(neighbours, "FREQUENT_SHARE", 0.0)
    assert found() == mixed
