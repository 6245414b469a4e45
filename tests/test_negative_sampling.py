"""Negative sampling: planted groups of words, reruns, and its parts."""

import dataclasses
import random

import numpy as np
import pytest

from lexiloom.config import EmbeddingConfig
from lexiloom.operators import negative_sampling as ns

CFG = EmbeddingConfig(vector_size=16, window=3, min_count=3, epochs=4, text_column="text", min_review_tokens=2)


def corpus(spark, n=900, groups=5):
    rng = random.Random(6)
    words = [[f"g{g}w{i}" for i in range(8)] for g in range(groups)]
    rows = [(i, " ".join(rng.choice(words[i % groups]) for _ in range(rng.randint(6, 14)))) for i in range(n)]
    return spark.createDataFrame(rows + [(None, "lonely"), (-1, None), (-2, ""), (-3, "g0w1 g0w2")], "row_id long, text string")


def margins(table):
    """Mean cosine within planted groups and between them."""
    words = sorted(table)
    m = np.array([table[w] for w in words])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s, same = m @ m.T, np.array([[a[:2] == b[:2] for b in words] for a in words])
    off = ~np.eye(len(words), dtype=bool)
    return s[same & off].mean(), s[~same].mean()


@pytest.mark.parametrize("architecture", ["skipgram", "cbow"])
@pytest.mark.parametrize("blocks", [1, 3])
def test_planted_groups_are_close(spark, architecture, blocks):
    cfg = dataclasses.replace(CFG, architecture=architecture)
    training = ns.Training(least_blocks=blocks, sample=None, start_rate=0.05, batch=32)
    found = {r.word: r.vector for r in ns.fit(corpus(spark), cfg, training).collect()}
    assert sorted(found) == sorted(f"g{g}w{i}" for g in range(5) for i in range(8))
    within, between = margins(found)
    assert within > between + 0.3


def test_reruns_and_layouts_give_the_same_vectors(spark):
    cfg, training = dataclasses.replace(CFG, epochs=1), ns.Training(least_blocks=2)
    docs = corpus(spark, 200)
    one = {r.word: r.vector for r in ns.fit(docs, cfg, training).collect()}
    two = {r.word: r.vector for r in ns.fit(docs.repartition(5), cfg, training).collect()}
    assert one == two and len(one) > 30
    assert ns.fit(docs.limit(0), cfg, training).count() == 0


def test_noise_follows_its_weights():
    weights = np.array([1.0, 2.0, 3.0, 10.0, 0.5])
    got = np.bincount(ns.draw(ns.alias_table(weights), 200_000, np.random.default_rng(1)), minlength=5) / 200_000
    assert np.abs(got - weights / weights.sum()).max() < 0.005


def test_steps_follow_the_gradient():
    rng = np.random.default_rng(2)
    inputs, outputs = rng.normal(size=(6, 4)), rng.normal(size=(6, 4))
    ins, lens, outs, noise = np.array([0, 1, 2]), np.array([1, 2]), np.array([3, 4]), np.array([[5], [4]])

    def loss(a, b):
        total, at = 0.0, 0
        for e in range(2):
            h = a[ins[at:at + lens[e]]].mean(0)
            at += lens[e]
            total -= np.log(1 / (1 + np.exp(-h @ b[outs[e]])))
            total -= sum(np.log(1 / (1 + np.exp(h @ b[w]))) for w in noise[e] if w != outs[e])
        return total

    a, b = inputs.copy(), outputs.copy()
    ns.train_batch(a, b, ins, lens, outs, noise, 1e-4)
    for w in range(6):
        for d in range(4):
            moved = outputs.copy()
            moved[w, d] += 1e-6
            assert (b - outputs)[w, d] == pytest.approx(-1e-4 * (loss(inputs, moved) - loss(inputs, outputs)) / 1e-6, abs=1e-8)
    assert loss(a, b) < loss(inputs, outputs)
