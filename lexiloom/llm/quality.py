"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics."""

from __future__ import annotations

import dataclasses
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.llm.common import written
from lexiloom.session import ship_package

STATISTICS = (
    "words", "word_length", "longest_word", "letters", "digits", "upper", "marks", "spaces", "other",
    "distinct_words", "top_word", "distinct_pairs", "lines", "line_length", "distinct_lines",
    "exclaimed", "sentence_length",
)

# Classes of single bytes. 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 space, 5 mark, 6 beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[list(b"!?.,;:'\"()-")], _CLASS[128:] = 4, 5, 6


def text_statistics(text: str | None) -> list[float]:
    """The values of STATISTICS for a whole text; all 0 for null or empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7) / len(raw)
    words = raw.lower().split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = raw.split(b"\n")
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, float(max(map(len, words), default=0)),
        kinds[1] + kinds[2] + kinds[6], kinds[3], kinds[2] / max(1e-9, kinds[1] + kinds[2]), kinds[5],
        kinds[4], kinds[0], len(counts) / n, max(counts.values(), default=0) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1), math.log1p(len(lines)), len(raw) / len(lines),
        len(set(lines)) / len(lines), raw.count(b"!") / n, n / (1 + raw.count(b".")),
    ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_stats``, a struct of STATISTICS; only the text passes through Arrow."""
    ship_package(docs.sparkSession)

    def f(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_statistics(t) for t in texts], columns=list(STATISTICS), dtype=float)

    udf = F.pandas_udf(f, ", ".join(f"{s} double" for s in STATISTICS))
    return docs.select("*", udf(F.col(text)).alias("_stats"))


@dataclasses.dataclass(frozen=True)
class Rule:
    """All of (statistic, is_at_most, threshold) hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self, stats: str = "_stats") -> Column:
        out = F.lit(True)
        for name, at_most, threshold in self.conditions:
            value = F.col(f"{stats}.{name}")
            out = out & ((value <= threshold) if at_most else (value > threshold))
        return out


@dataclasses.dataclass(frozen=True)
class RuleEnsemble:
    """probability = sigmoid(intercept + sum of the weights of the rules that hold)."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def score(self, stats: str = "_stats") -> Column:
        """The whole ensemble as one column expression, part of the stage's generated code."""
        logit = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            logit = logit + F.when(rule.column(stats), F.lit(float(weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-logit))


def _paths(node, names: tuple[str, ...], so_far: tuple = ()) -> list[Rule]:
    """Every path from the root to a node below it."""
    rules = [Rule(so_far)] if so_far else []
    if node.numDescendants() == 0:
        return rules
    split = node.split()
    name, threshold = names[split.featureIndex()], float(split.threshold())
    for child, at_most in ((node.leftChild(), True), (node.rightChild(), False)):
        rules += _paths(child, names, (*so_far, (name, at_most, threshold)))
    return rules


def _canonical(rule: Rule) -> Rule:
    """The tightest bound of each statistic and side, in one order."""
    tight: dict[tuple[str, bool], float] = {}
    for name, at_most, t in rule.conditions:
        old = tight.get((name, at_most), t)
        tight[name, at_most] = min(old, t) if at_most else max(old, t)
    return Rule(tuple(sorted((n, a, t) for (n, a), t in tight.items())))


def fit_quality(docs: DataFrame, labels: DataFrame, *, where: Column | None = None, key: str = "doc_id",
                text: str = "text", label: str = "quality", per_class: int = 3000, trees: int = 24,
                depth: int = 3, lasso: float = 0.002, seed: int = 11) -> RuleEnsemble:
    """Fits on at most ``per_class`` rows of each label (0, 1), those with the smallest key hash.

    A forest of shallow trees on the statistics proposes rules: every path in every tree. A logistic
    regression with an L1 penalty on the rules' indicators weights them and drops most. Rows are weighted
    back to the classes' shares among all labelled rows. The sampled ids are few and broadcast to the
    scan of the texts. Without labels the score is 0.5; with one class only it is that class's
    smoothed share. Null labels are passed over; rows that repeat an id count once.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    marked = (marked if where is None else marked.where(where)).groupBy(F.col(key).alias("_id")).agg(
        F.max(F.col(label).cast("double")).alias("_y"))
    sizes = {r[0]: r[1] for r in marked.groupBy("_y").count().collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        share = (sizes.get(1.0, 0) + 0.5) / (total + 1)
        return RuleEnsemble(math.log(share / (1 - share)))
    h = F.md5(F.col("_id").cast("string"))
    rank = F.row_number().over(W.partitionBy("_y").orderBy(h, "_id"))
    ids = marked.withColumn("_r", rank).where(F.col("_r") <= per_class).drop("_r")
    weight = F.when(F.col("_y") == 1, sizes[1.0] / min(per_class, sizes[1.0])).otherwise(
        sizes[0.0] / min(per_class, sizes[0.0])) / F.lit(total / sum(min(per_class, n) for n in sizes.values()))
    chosen = (docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
              .join(F.broadcast(ids), F.col("_key") == F.col("_id")))
    sample = with_statistics(chosen, "_text").select("_id", "_y", weight.alias("_w"), "_stats")
    # In one order and one partition (bounded), so that a second fit finds the same rules.
    sample = written(sample.repartition(1).sortWithinPartitions("_id", F.xxhash64("_stats")), "sample")
    flat = sample.select("_y", "_w", "_stats", *[F.col(f"_stats.{s}").alias(s) for s in STATISTICS])
    forest = RandomForestClassifier(
        labelCol="_y", weightCol="_w", featuresCol="_x", numTrees=trees, maxDepth=depth, maxBins=64,
        subsamplingRate=0.7, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=seed).fit(
        VectorAssembler(inputCols=list(STATISTICS), outputCol="_x").transform(flat))
    rules = sorted({_canonical(r) for t in forest.trees for r in _paths(t._call_java("rootNode"), STATISTICS)},
                   key=lambda r: r.conditions)
    if not rules:
        share = sizes[1.0] / total
        return RuleEnsemble(math.log(share / (1 - share)))
    held = sample.select("_y", "_w", *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    lasso_fit = LogisticRegression(
        labelCol="_y", weightCol="_w", featuresCol="_x", elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(
        VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="_x").transform(held))
    kept = [(r, float(w)) for r, w in zip(rules, lasso_fit.coefficients.toArray()) if w]
    return RuleEnsemble(float(lasso_fit.intercept), tuple(kept))


def score_quality(docs: DataFrame, ensemble: RuleEnsemble, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) to every row; null and empty texts have statistics of 0.

    A row's score depends on its text alone. A column named score is replaced.
    """
    own = [c for c in docs.columns if c not in ("score", "_stats")]
    return with_statistics(docs.select(*own), text).select(*own, ensemble.score().alias("score"))
