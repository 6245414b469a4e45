"""Latent-space analysis: purity, centroids, projections, cluster summaries, insights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import mlvectors
from lexiloom.functions import vectors as vec
from lexiloom.operators import neighbours, reports, sampling
from lexiloom.operators import vocabulary as vb


# ---------------------------------------------------------------- purity
def row_purity(
    df: DataFrame, key: str, labels: Sequence[str], k: int = 10, vector: str = "vector",
    queries: DataFrame | None = None, ranked: DataFrame | None = None, **nearest_options,
) -> DataFrame:
    """Share of a row's k nearest neighbours that carry its label, for each label column.

    ``queries`` defaults to all rows. ``ranked`` gives neighbours found before, such as those of
    ``neighbour_graph``; then none are searched. Columns: key, the labels, purity_<label>.
    """
    asked = df if queries is None else queries
    payload = [f"_n_{c}" for c in labels]
    corpus = df.select(key, vector, *[F.col(c).alias(f"_n_{c}") for c in labels])
    if ranked is None:
        ranked = neighbours.nearest(
            asked.select(key, vector), corpus, k, key, key, vector, payload=payload, **nearest_options
        )
    else:
        near = corpus.drop(vector).withColumnRenamed(key, "neighbor_id")
        ranked = ranked.filter(F.col("neighbor_rank") <= k).join(near, "neighbor_id")
    own = asked.select(F.col(key).alias("query_id"), *labels)
    return (
        ranked.join(own, "query_id")
        .groupBy(F.col("query_id").alias(key), *labels)
        .agg(*[
            F.avg(F.col(c).eqNullSafe(F.col(f"_n_{c}")).cast("double")).alias(f"purity_{c}")
            for c in labels
        ])
    )


def sampled_queries(df: DataFrame, label: str, key: str, limit: int | None, seed=42) -> DataFrame:
    """At most ``limit`` query rows per class."""
    return df if limit is None else sampling.exact_per_group(df, limit, key, [label], seed)


def neighbourhood_purity(
    df: DataFrame, key: str, label: str, k: int = 10, query_limit: int | None = 1000,
    vector: str = "vector", seed=42, **nearest_options,
) -> DataFrame:
    """Purity per class from sampled queries: mean, std (population), n."""
    queries = sampled_queries(df.select(key, label, vector), label, key, query_limit, seed)
    per_row = row_purity(df, key, [label], k, vector, queries, **nearest_options)
    p = f"purity_{label}"
    return per_row.groupBy(F.col(label).alias("class")).agg(
        F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), F.count("*").alias("n")
    )


def mean_purity(per_class: DataFrame) -> DataFrame:
    """Mean over all queries, from the per-class table."""
    return per_class.agg(
        (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean_purity"),
        F.sum("n").alias("queries"),
    )


# ---------------------------------------------------------------- centroids
def centroids(
    df: DataFrame, label: str, vector: str = "vector", normalize: bool = False
) -> DataFrame:
    """Mean vector per class, on raw or unit-length vectors; partial sums before the shuffle."""
    v = vec.normalize(vector) if normalize else vec.as_double(vector)
    mean = Summarizer.metrics("mean").summary(F.col("_v"))
    return (
        df.select(label, mlvectors.dense(v).alias("_v"))
        .groupBy(label).agg(mean.alias("s"), F.count("*").alias("rows"))
        .select(label, "rows", vector_to_array("s.mean").alias("centroid"))
    )


def pairwise_cosine(
    df: DataFrame, key: str, vector: str, max_rows: int = 5_000, digits: int = 12
) -> DataFrame:
    """Full cosine matrix of a small set as (key_a, key_b, cosine), both triangles.

    The set is small, which is checked, so it reaches every row as one list and nothing is
    joined on the dimension. For larger sets ask for the k nearest instead.
    """
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows; use neighbours.nearest")
    unit = df.select(F.col(key).alias("k"), vec.normalize(vector).alias("v"))
    listed = unit.agg(F.collect_list(F.struct("k", "v")))
    pairs = unit.select("k", "v", F.explode(listed.scalar()).alias("o"))
    return pairs.select(
        F.col("k").alias(f"{key}_a"), F.col("o.k").alias(f"{key}_b"),
        F.round(vec.dot("v", F.col("o.v")), digits).alias("cosine"),
    )


def centroid_similarity(
    df: DataFrame, label: str, vector: str = "vector", normalize: bool = False
) -> DataFrame:
    """Cosine of every pair of class centroids, long form."""
    return pairwise_cosine(centroids(df, label, vector, normalize), label, "centroid")


def similarity_matrix(similarity: DataFrame, label: str) -> DataFrame:
    """The long form as a square table."""
    return similarity.groupBy(f"{label}_a").pivot(f"{label}_b").agg(F.first("cosine"))


def most_similar_pair(similarity: DataFrame, label: str) -> DataFrame:
    """The closest pair of different classes (ties: smallest labels)."""
    a, b = f"{label}_a", f"{label}_b"
    best = F.min(F.struct((-F.col("cosine")).alias("c"), F.col(a).alias("a"), F.col(b).alias("b")))
    return similarity.filter(F.col(a) < F.col(b)).agg(best.alias("m")).select(
        F.col("m.a").alias("class_a"), F.col("m.b").alias("class_b"), (-F.col("m.c")).alias("cosine")
    )


# ---------------------------------------------------------------- projection
def plane_projection(
    df: DataFrame, key: str, label: str, cap: int = 2500, vector: str = "vector", seed=42,
    carry=(),
) -> DataFrame:
    """Two principal coordinates, with mean 0, of a balanced sample of unit-length vectors."""
    sample = sampling.smallest_class_sample(
        df.select(key, label, *carry, vector), cap, key, label, seed
    ).withColumn("_v", mlvectors.dense(vec.normalize(vector)))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(sample)
    at = vector_to_array("_p")
    placed = model.transform(sample).select(
        key, label, *carry, at[0].alias("x"), at[1].alias("y")
    )
    return placed.withColumns({c: F.col(c) - placed.agg(F.avg(c)).scalar() for c in ("x", "y")})


# ---------------------------------------------------------------- clusters
def cluster_summary(
    df: DataFrame, key: str, cluster: str = "cluster", category: str = "main_category",
    sentiment: str = "sentiment", text: str | None = "cleaned_text",
    settings: vb.TermSettings = vb.TermSettings(**vb.KEYWORD_SETTINGS), top_n: int = 8,
) -> DataFrame:
    """Size, dominant labels with shares, and keywords of every cluster."""
    out = reports.group_mode(df, cluster, category, "dominant_category").join(
        reports.group_mode(df, cluster, sentiment, "dominant_sentiment").drop("size"), cluster
    )
    if text is not None:
        ranked = vb.cluster_terms(df, key, cluster, text, settings, top_n)
        out = out.join(vb.joined_terms(ranked, cluster), cluster, "left")
    return out.orderBy(cluster)


# ---------------------------------------------------------------- insights
def insights(
    purity: DataFrame, per_class: DataFrame, outliers: DataFrame, similarity: DataFrame,
    unified: DataFrame, label: str = "main_category", representation: str = "word2vec",
) -> DataFrame:
    """Facts of the latent-space report as (fact, subject, value), from finished tables."""
    p = f"purity_{label}"
    average = purity.agg(F.avg(p).alias("value")).select(
        F.lit("average_purity").alias("fact"), F.lit(label).alias("subject"), "value"
    )
    ends = reports.extremes(per_class, "class", "mean").select(
        F.inline(F.array(
            F.struct(F.lit("best_class").alias("fact"), F.col("best").cast("string").alias("subject"),
                     F.col("best_value").alias("value")),
            F.struct(F.lit("worst_class").alias("fact"), F.col("worst").cast("string").alias("subject"),
                     F.col("worst_value").alias("value")),
        ))
    )
    top = reports.group_mode(outliers.withColumn("_all", F.lit(1)), "_all", label, "dominant").select(
        F.lit("dominant_outlier_class").alias("fact"),
        F.col("dominant").cast("string").alias("subject"), F.col("dominant_share").alias("value"),
    )
    pair = most_similar_pair(similarity, label).select(
        F.lit("closest_centroids").alias("fact"),
        F.concat_ws(" & ", F.col("class_a").cast("string"), F.col("class_b").cast("string"))
        .alias("subject"),
        F.col("cosine").alias("value"),
    )
    scores = unified.filter(F.col("representation") == representation).select(
        F.inline(F.array(*[
            F.struct(F.lit(f"{t}_macro_f1").alias("fact"), F.col("representation").alias("subject"),
                     F.col(f"{t}_test_macro_f1").alias("value"))
            for t in ("category", "sentiment")
        ]))
    )
    out = average
    for part in (ends, top, pair, scores):
        out = out.unionByName(part)
    return out


def insight_sentences(facts: DataFrame) -> DataFrame:
    """One line of text per fact."""
    return facts.select(
        "fact", F.format_string("%s: %s (%.3f)", "fact", "subject", "value").alias("sentence")
    )
