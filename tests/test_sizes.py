"""The same rows whatever the size switch, and no setting that silently drops any."""

import random

import numpy as np
import pytest

from lexiloom.config import EmbeddingConfig
from lexiloom.functions import casts
from lexiloom.operators import neighbours, pooling, shaping, word_vectors
from lexiloom.plans import jobs


def test_dropping_copies_gives_the_same_rows_in_both_forms(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = [(i, centres[i % 8] if i % 3 else [x + rng.gauss(0, 0.01) for x in centres[i % 8]]) for i in range(136)]
    df = spark.createDataFrame(rows, "row_id long, vector array<double>")
    few, many = (
        neighbours.nearest(df, df, 3, drop_exact=True, broadcast_queries=n, block_rows=16).collect()
        for n in (20_000, 0)
    )
    assert len(few) == 3 * 136 and sorted(few) == sorted(many)


def test_pooling_forms_agree_on_null_and_repeated_keys(spark):
    docs = spark.createDataFrame(
        [(1, ["a", "b"]), (1, ["c"]), (None, ["a"]), (2, []), (3, ["x"]), (4, None)],
        "row_id long, tokens array<string>")
    words = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [2.0, 2.0]), ("c", [9.0, 9.0]), (None, [5.0, 5.0])],
        "word string, vector array<double>")
    kept, joined = (
        sorted((str(r.row_id), [float(x) for x in r.vector]) for r in pooling.mean_pool(
            docs, words, 2, max_bytes=n).collect()) for n in (1 << 20, 0))
    assert kept == joined and ("1", [2.0, 2.0]) in kept and ("None", [1.0, 0.0]) in kept and len(kept) == 6


def test_whole_numbers_above_2_to_the_53(spark):
    df = spark.createDataFrame([("9007199254740993",), ("3.0",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(casts.to_whole("v")).collect()] == [9007199254740993, 3, None, None]


def test_sparse_queries_without_a_term_are_still_queries(spark):
    info = spark.createDataFrame([(1,), (2,)], "row_id long")
    rows = spark.createDataFrame([(1, [0], [1.0])], "row_id long, indices array<int>, weights array<double>")
    found = {r.row_id: (r.indices, r.weights) for r in jobs._with_sparse(info, rows, "row_id").collect()}
    assert found == {1: ([0], [1.0]), 2: ([], [])}


def test_word_vectors_learn_from_whole_texts(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(g) for _ in range(12))
             for g in (["sun", "warm", "beach", "sea"], ["ice", "cold", "snow", "frost"]) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "cleaned_text string")
    cfg = EmbeddingConfig(vector_size=8, min_count=1, epochs=5, window=4)
    assert cfg.max_review_tokens == 0
    found = {r.word: np.array(r.vector) for r in word_vectors.word_table(
        word_vectors.fit(df, cfg, partitions=1)).collect()}
    cos = lambda a, b: found[a] @ found[b] / np.linalg.norm(found[a]) / np.linalg.norm(found[b])
    assert cos("sun", "beach") > cos("sun", "snow") and cos("ice", "snow") > cos("ice", "sea")


def test_cleaning_without_a_text_is_an_error(spark):
    with pytest.raises(ValueError, match="no column"):
        shaping.with_cleaned_text(spark.createDataFrame([(1,)], "rating int"))
