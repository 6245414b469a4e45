"""What a task holds, shuffles or repeats as tables grow, and that the results stay those of the plain forms."""

import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lexiloom.functions import text as tx
from lexiloom.operators import latent_semantic, neighbour_graph, neighbours, splits
from lexiloom.operators import vocabulary as vb

TEXTS = ["a red car red car", "", None, "red  car\tstop x red", "stop", "red car red car red car", "the the the"]


@pytest.mark.parametrize("low, high, stop", [(1, 1, ()), (1, 2, ()), (2, 3, ()), (1, 4, ("stop",))])
def test_terms_counted_as_numbers_are_those_of_the_rows(low, high, stop):
    s = vb.TermSettings(low=low, high=high, stop_words=stop)
    found = [vb.row_terms(t, s, frozenset(stop)) for t in TEXTS]
    cf, df = Counter(t for f in found for t in f), Counter(t for f in found for t in set(f))
    lists = [pc.ascii_split_whitespace(pa.array(TEXTS[:3], pa.string())), pc.ascii_split_whitespace(pa.array(TEXTS[3:]))]
    rows = pa.Table.from_batches(vb._counted(lists, s)).to_pylist()
    assert len(rows) == len(cf)
    assert {r["term"]: (r["df"], r["cf"]) for r in rows} == {t: (df[t], cf[t]) for t in cf}


def test_term_summary_of_repeated_and_null_keys(spark):
    rows = [(1, "red car"), (1, "red car red"), (2, "stop"), (3, ""), (None, "red car"), (None, "car"), (4, ""), (4, "to be"), (5, None)]
    df = spark.createDataFrame(rows, "k int, t string")
    found = df.select("k", F.explode(tx.terms("t")).alias("term")).groupBy("k").agg(
        F.count("*").alias("terms"), F.count_distinct("term").alias("distinct_terms"),
        F.min("term").alias("first_term"), F.max("term").alias("last_term"))
    got = vb.term_summary(df, "k", tx.terms("t"))
    key = lambda r: str(r)
    assert sorted(got.collect(), key=key) == sorted(found.collect(), key=key) and got.count() == 4
    single = vb.term_summary(df.filter("k = 2"), "k", tx.terms("t"))
    assert "Generate" not in single._jdf.queryExecution().toString()  # no row per term


def test_lists_and_long_weights_give_the_same_rows(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (1, "bb cc"), (2, "cc"), (3, "zz"), (None, "aa"), (None, "cc cc")], "k int, t string")
    known = spark.createDataFrame([("aa", 1.5, 2), ("bb", 1.0, 0), ("cc", 2.0, 1)], "term string, idf double, term_id int")
    s = vb.TermSettings(max_features=3, high=1)
    rows = vb.sparse_documents(df, known, "k", "t", s)
    rounded = lambda d: sorted((str(r["k"]), r["indices"], [round(w, 12) for w in r["weights"]]) for r in d.collect())
    listed = vb.sparse_rows(rows, "k")
    assert rounded(listed) == rounded(vb.sparse_rows(vb.long_weights(rows, "k"), "k"))
    assert "Generate" not in listed._jdf.queryExecution().toString()  # lists are shuffled as they are
    project = lambda d, m: sorted((str(r["k"]), [round(float(x), 4) for x in r["vector"]]) for r in latent_semantic.project(d, m, "k").collect())
    model = latent_semantic.fit(rows, "k", 3, 2)
    assert project(rows, model) == project(vb.long_weights(rows, "k"), model)


def test_dense_chunks_of_the_svd_are_multiplied_as_matrices():
    rng = np.random.default_rng(0)
    term = np.concatenate([np.sort(rng.choice(40, 9, replace=False)) for _ in range(30)])
    weight, starts, basis = rng.random(len(term)), np.arange(0, len(term), 9), rng.random((40, 5))
    whole = np.zeros((30, 40))
    whole[np.repeat(np.arange(30), 9), term] = weight
    assert latent_semantic._as_matrix(term, weight, starts, 40).shape == (30, 40)
    assert latent_semantic._as_matrix(term, weight, starts, 40_000) is None
    for size in (40, 40_000):  # as a matrix, and entry by entry
        wide, out = np.zeros((size, 5)), np.zeros((size, 5))
        wide[:40] = basis
        latent_semantic._back_and_forth(out, wide, term, weight, starts)
        assert np.allclose(out[:40], whole.T @ (whole @ basis))


def test_exact_split_reads_the_rows_once_for_its_groups(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(300).selectExpr("id", "concat('g', id % 20) as g").mapInArrow(count, "id long, g string")
    assert splits.by_group_exact(rows, "g").count() == 300
    assert seen.value <= 600


def test_merged_lists_of_the_graph_keep_the_best_of_each_id(spark):
    rows = [(1, [2, 3], [0.9, 0.5]), (1, [3, 4], [0.5, 0.5]), (2, [1], [0.9]), (3, [1, 2, 4], [0.5, 0.4, 0.1]), (3, [4], [0.1]), (3, [5], [0.7])]
    kind = spark.range(1).schema["id"].dataType
    schema = neighbour_graph._lists(kind)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in ("1", "2", before):  # an id's lists come in one batch or several
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            merged = neighbour_graph._merged(spark.createDataFrame(rows, schema), 3, kind, to_arrow_schema(schema))
            assert "collect_list" not in merged._jdf.queryExecution().toString()
            assert {r["id"]: (r["near"], r["score"]) for r in merged.collect()} == {
                1: ([2, 3, 4], [0.9, 0.5, 0.5]), 2: ([1], [0.9]), 3: ([5, 1, 2], [0.7, 0.5, 0.4])}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_scores_of_a_block_take_little_memory():
    rng = np.random.default_rng(1)
    rows = pa.table({"neighbor_id": pa.array(np.arange(4000)), "vector": pa.array(list(rng.random((4000, 8))))})
    unit = neighbours._matrix(rows.column("vector"))
    best = neighbours._Best(4000, 5)
    tracemalloc.start()
    neighbours._score_rows(best, unit, pd.Index(np.arange(4000)), rows, "vector", {"digits": 9, "drop_exact": False})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert best.table(pa.array(np.arange(4000))).num_rows == 20_000 and peak < 64 << 20
