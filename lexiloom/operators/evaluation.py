"""Scores from predictions, rankings and clusters, and the comparison of representations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# ---------------------------------------------------------------- classification
def classification_scores(
    df: DataFrame, truth: str = "y_true", predicted: str = "y_pred", by=()
) -> DataFrame:
    """accuracy and macro-F1 per group.

    The data is reduced to a confusion table once; the rest works on classes.
    Macro-F1 averages over labels seen in truth or prediction; an undefined F1 is 0.
    """
    by = list(by)
    confusion = df.groupBy(*by, truth, predicted).agg(F.count("*").alias("n"))
    sides = confusion.select(
        *by,
        F.inline(F.array(
            F.struct(F.col(truth).alias("label"), F.col("n").alias("support"),
                     F.lit(0).cast("long").alias("claimed"),
                     F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("support"),
                     F.col("n").alias("claimed"), F.lit(0).cast("long").alias("hit")),
        )),
    )
    per_label = sides.groupBy(*by, "label").agg(
        F.sum("support").alias("support"), F.sum("claimed").alias("claimed"),
        F.sum("hit").alias("hit"),
    )
    f1 = F.coalesce(
        F.try_divide(F.col("hit") * 2.0, (F.col("support") + F.col("claimed")).cast("double")),
        F.lit(0.0),
    )
    return per_label.groupBy(*by).agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg(f1).alias("macro_f1")
    )


# ---------------------------------------------------------------- retrieval
def first_relevant(ranked: DataFrame, relevant: str = "relevant", by=()) -> DataFrame:
    """Rank of the first relevant neighbour per query; null when there is none."""
    hit = F.when(F.col(relevant), F.col("neighbor_rank"))
    return ranked.groupBy(*by, "query_id").agg(F.min(hit).alias("first_rank"))


def retrieval_scores(ranked: DataFrame, k: int = 10, relevant: str = "relevant", by=()) -> DataFrame:
    """Hit rate ("recall") and mean reciprocal rank at k from ranked neighbours.

    One row per (query, rank) with a relevance flag. Ranks beyond k are ignored.
    Without queries the scores are null.
    """
    per_query = first_relevant(ranked.filter(F.col("neighbor_rank") <= k), relevant, by)
    return per_query.groupBy(*by).agg(
        F.avg(F.when(F.col("first_rank").isNotNull(), 1.0).otherwise(0.0)).alias(f"recall_at_{k}"),
        F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias(f"mrr_at_{k}"),
        F.count("*").alias("queries"),
    )


# ---------------------------------------------------------------- clustering
def cluster_agreement(df: DataFrame, label: str, cluster: str = "cluster", by=()) -> DataFrame:
    """Normalised mutual information (arithmetic mean) and adjusted Rand index.

    Everything after the first aggregation works on the contingency table
    (labels x clusters). Marginals are attached to its cells, so that sums over
    cells give entropies and pair counts directly.
    """
    by = list(by)
    cells = df.groupBy(*by, label, cluster).agg(F.count("*").cast("double").alias("n"))
    cells = cells.select(
        *by, "n",
        F.sum("n").over(W.partitionBy(*by, label)).alias("a"),
        F.sum("n").over(W.partitionBy(*by, cluster)).alias("b"),
        F.sum("n").over(W.partitionBy(*by)).alias("t"),
    )
    n, a, b, t = (F.col(c) for c in "nabt")
    sums = cells.groupBy(*by).agg(
        F.sum(n / t * F.log(t * n / (a * b))).alias("mi"),
        (-F.sum(n / t * F.log(a / t))).alias("ha"),
        (-F.sum(n / t * F.log(b / t))).alias("hb"),
        F.sum(n * (n - 1) / 2).alias("both"),
        F.sum(n * (a - 1) / 2).alias("same_label"),
        F.sum(n * (b - 1) / 2).alias("same_cluster"),
        F.max(t * (t - 1) / 2).alias("pairs"),
    )
    expected = F.coalesce(
        F.try_divide(F.col("same_label") * F.col("same_cluster"), F.col("pairs")), F.lit(0.0)
    )
    mean_pairs = (F.col("same_label") + F.col("same_cluster")) / 2
    nmi = F.coalesce(
        F.try_divide(F.greatest(F.col("mi"), F.lit(0.0)), (F.col("ha") + F.col("hb")) / 2),
        F.lit(1.0),  # one label and one cluster agree perfectly
    )
    ari = F.coalesce(
        F.try_divide(F.col("both") - expected, mean_pairs - expected), F.lit(1.0)
    )
    return sums.select(*by, nmi.alias("nmi"), ari.alias("ari"))


def clustering_report(
    df: DataFrame, category: str = "main_category", sentiment: str = "sentiment",
    cluster: str = "cluster", by=(),
) -> DataFrame:
    """nmi and ari against both label sets, one row per group."""
    by = list(by)
    pairs = F.array(
        F.struct(F.lit("category").alias("target"), F.col(category).cast("string").alias("label")),
        F.struct(F.lit("sentiment").alias("target"), F.col(sentiment).cast("string").alias("label")),
    )
    both = df.select(*by, cluster, F.inline(pairs))
    scores = cluster_agreement(both, "label", cluster, [*by, "target"])

    def pick(value: str, target: str):
        return F.max(F.when(F.col("target") == target, F.col(value))).alias(f"{value}_{target}")

    return scores.groupBy(*by).agg(
        pick("nmi", "category"), pick("ari", "category"),
        pick("nmi", "sentiment"), pick("ari", "sentiment"),
    )


# ---------------------------------------------------------------- comparison
def unified_table(
    classification: DataFrame, retrieval: DataFrame, clustering: DataFrame, k: int = 10
) -> DataFrame:
    """Test scores of both tasks next to retrieval and clustering, best category F1 first."""
    def pick(value: str, name: str):
        return F.max(F.when(F.col("task") == name, F.col(value))).alias(f"{name}_test_{value}")

    # One pass over the classification scores; a representation needs both tasks.
    tasks = ("sentiment", "category")
    scores = classification.filter(F.col("split") == "test").groupBy("representation").agg(
        *[pick(v, t) for t in tasks for v in ("macro_f1", "accuracy")],
        *[F.count_if(F.col("task") == t).alias(f"_{t}") for t in tasks],
    )
    return (
        scores.filter("_sentiment > 0 AND _category > 0").drop("_sentiment", "_category")
        .join(retrieval.select("representation", f"recall_at_{k}", f"mrr_at_{k}"),
              "representation", "left")
        .join(clustering, "representation", "left")
        .orderBy(F.desc("category_test_macro_f1"), "representation")
    )


def metric_rank(df: DataFrame, metric: str, name: str) -> DataFrame:
    """Competition rank, best first (equal scores share the better rank); report tables only."""
    return df.withColumn(name, F.rank().over(W.orderBy(F.desc(metric))))


def winners(unified: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """Best representation per metric; ``metrics`` maps a task name to its column."""
    pairs = F.array(*[
        F.struct(F.lit(t).alias("task"), F.col(c).alias("value")) for t, c in metrics.items()
    ])
    long = unified.select("representation", F.inline(pairs))
    best = F.min(F.struct((-F.col("value")).alias("v"), F.col("representation").alias("r")))
    return long.filter(F.col("value").isNotNull()).groupBy("task").agg(best.alias("b")).select(
        "task", F.col("b.r").alias("representation"), (-F.col("b.v")).alias("value")
    )


def winner_statement(unified: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Whether one representation wins both tasks, as a row and as a sentence."""
    w = winners(unified, dict([first, second]))
    pick = lambda t: F.max(F.when(F.col("task") == t, F.col("representation")))
    row = w.agg(pick(first[0]).alias("first_winner"), pick(second[0]).alias("second_winner"))
    same = F.col("first_winner") == F.col("second_winner")
    text = F.when(
        same, F.format_string("%s wins both tasks", "first_winner")
    ).otherwise(
        F.format_string(f"{first[0]}: %s, {second[0]}: %s", "first_winner", "second_winner")
    )
    return row.withColumn("same_winner", same).withColumn("statement", text)


def snapshot(unified: DataFrame, columns, sort_by: str = "mrr_at_10", digits: int = 4) -> DataFrame:
    """Selected metrics rounded for display, best first."""
    return (
        unified.orderBy(F.desc(sort_by), "representation")
        .select("representation", *[F.round(c, digits).alias(c) for c in columns])
    )


def side_by_side(retrieval: DataFrame, clustering: DataFrame, k: int = 10) -> DataFrame:
    """Retrieval and clustering metrics looked up per representation, with both ranks."""
    joined = retrieval.select(
        "representation",
        F.col(f"mrr_at_{k}").alias(f"retrieval_mrr_at_{k}"),
        F.col(f"recall_at_{k}").alias(f"retrieval_recall_at_{k}"),
    ).join(
        clustering.select(
            "representation",
            F.col("nmi_category").alias("clustering_nmi_category"),
            F.col("ari_category").alias("clustering_ari_category"),
        ),
        "representation",
    )
    ranked = metric_rank(joined, f"retrieval_mrr_at_{k}", "retrieval_mrr_rank")
    return metric_rank(ranked, "clustering_nmi_category", "clustering_nmi_rank")


# ---------------------------------------------------------------- errors
def errors_only(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    return df.filter(F.col(truth) != F.col(predicted))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """How often each label occurs, e.g. among errors."""
    return df.groupBy(label).agg(F.count("*").alias("count")).orderBy(F.desc("count"), label)


def confusion_pairs(
    df: DataFrame, truth: str = "y_true", predicted: str = "y_pred", top_n: int = 10
) -> DataFrame:
    """Most frequent wrong (true, predicted) pairs."""
    return (
        errors_only(df, truth, predicted)
        .groupBy(F.col(truth).alias("true_label"), F.col(predicted).alias("predicted_label"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "true_label", "predicted_label")
        .limit(top_n)
    )


def misclassified_examples(
    df: DataFrame, key: str, text: str = "cleaned_text", truth: str = "y_true",
    predicted: str = "y_pred", n: int = 50, seed=42,
) -> DataFrame:
    """A random sample of errors in key order."""
    from lexiloom.operators.sampling import exact

    return (
        exact(errors_only(df, truth, predicted), n, key, seed)
        .select(key, text, F.col(truth).alias("true_label"), F.col(predicted).alias("predicted_label"))
        .orderBy(key)
    )


def first_errors(df: DataFrame, key: str, n: int = 5, truth="y_true", predicted="y_pred") -> DataFrame:
    """The first n errors in key order."""
    return errors_only(df, truth, predicted).orderBy(key).limit(n)
