"""Queries over predictions, rankings, clusters and the comparison of representations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.operators import evaluation, latent_space, reports
from lexiloom.functions import labels
from lexiloom.plans.registry import query
from lexiloom.plans.tables import PREDICTIONS_SQL, predictions, table

_D = 12  # digits compared


# ---------------------------------------------------------------- classification
_SCORES_SQL = f"""{PREDICTIONS_SQL},
confusion AS (SELECT representation, task, split, y_true, y_pred, count(*) AS n FROM predictions
              WHERE split <> 'train' GROUP BY ALL),
sides AS (
  SELECT representation, task, split, y_true AS label, n AS support, 0 AS claimed,
         CASE WHEN y_true = y_pred THEN n ELSE 0 END AS hit FROM confusion
  UNION ALL SELECT representation, task, split, y_pred, 0, n, 0 FROM confusion),
per AS (SELECT representation, task, split, label, sum(support) AS s, sum(claimed) AS c, sum(hit) AS h
        FROM sides GROUP BY ALL),
classification AS (
  SELECT representation, task, split, round((sum(h) / sum(s))::DOUBLE, {_D}) AS accuracy,
         round(avg(CASE WHEN s + c = 0 THEN 0 ELSE 2.0::DOUBLE * h / (s + c) END), {_D}) AS macro_f1
  FROM per GROUP BY 1, 2, 3)"""


def _classification(spark, sf) -> DataFrame:
    held = predictions(spark, sf).filter("split <> 'train'")
    df = evaluation.classification_scores(held, by=["representation", "task", "split"])
    return reports.rounded(df, ["accuracy", "macro_f1"], _D)


@query(f"WITH {_SCORES_SQL} SELECT * FROM classification")
def classification_scores(spark, sf):
    return _classification(spark, sf)


@query(f"WITH {_SCORES_SQL} SELECT * FROM classification ORDER BY task, split, macro_f1 DESC, representation")
def classification_table_sorted(spark, sf):
    return _classification(spark, sf).orderBy("task", "split", F.desc("macro_f1"), "representation")


@query(f"""WITH {PREDICTIONS_SQL} SELECT y_true AS true_label, y_pred AS predicted_label, count(*) AS count
FROM predictions WHERE representation = 'tfidf' AND task = 'category' AND y_true <> y_pred
GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10""")
def confusion_pairs(spark, sf):
    df = predictions(spark, sf).filter("representation = 'tfidf' AND task = 'category'")
    return evaluation.confusion_pairs(df)


@query(f"""WITH {PREDICTIONS_SQL} SELECT y_true, count(*) AS count FROM predictions
WHERE representation = 'lsa' AND task = 'sentiment' AND y_true <> y_pred GROUP BY 1""")
def error_labels(spark, sf):
    df = predictions(spark, sf).filter("representation = 'lsa' AND task = 'sentiment'")
    return evaluation.label_counts(evaluation.errors_only(df), "y_true")


@query("""SELECT o_orderkey, o_orderstatus AS y_true,
CASE WHEN o_totalprice < 150000 THEN 'F' ELSE 'O' END AS y_pred FROM orders
WHERE o_orderstatus <> CASE WHEN o_totalprice < 150000 THEN 'F' ELSE 'O' END
ORDER BY o_orderkey LIMIT 5""")
def first_errors(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("y_true"),
        F.when(F.col("o_totalprice") < 150000, "F").otherwise("O").alias("y_pred"),
    )
    return evaluation.first_errors(df, "o_orderkey", 5)


# ---------------------------------------------------------------- retrieval
_RANKED_SQL = f"""{PREDICTIONS_SQL},
ranked AS (SELECT representation, l_orderkey AS query_id, y_true = y_pred AS relevant,
  row_number() OVER (PARTITION BY representation, l_orderkey ORDER BY l_linenumber, y_true, y_pred)
    AS neighbor_rank FROM predictions WHERE task = 'category')"""
_RETRIEVAL_SQL = f"""{_RANKED_SQL},
firsts AS (SELECT representation, query_id, min(neighbor_rank) FILTER (relevant) AS r
           FROM ranked WHERE neighbor_rank <= 10 GROUP BY 1, 2),
retrieval AS (
  SELECT representation, round(avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 END), {_D}) AS recall_at_10,
         round(avg(coalesce(1.0::DOUBLE / r, 0)), {_D}) AS mrr_at_10, count(*) AS queries
  FROM firsts GROUP BY 1)"""


def _ranked(spark, sf) -> DataFrame:
    """An order is a query, its lines are the ranked answers."""
    order = W.partitionBy("representation", "query_id").orderBy("l_linenumber", "y_true", "y_pred")
    return (
        predictions(spark, sf).filter("task = 'category'")
        .withColumnRenamed("l_orderkey", "query_id")
        .withColumn("neighbor_rank", F.row_number().over(order))
        .select("representation", "query_id", "neighbor_rank",
                (F.col("y_true") == F.col("y_pred")).alias("relevant"))
    )


def _retrieval(spark, sf) -> DataFrame:
    df = evaluation.retrieval_scores(_ranked(spark, sf), 10, by=["representation"])
    return reports.rounded(df, ["recall_at_10", "mrr_at_10"], _D)


@query(f"WITH {_RETRIEVAL_SQL} SELECT * FROM retrieval")
def ranking_scores(spark, sf):
    return _retrieval(spark, sf)


@query(f"""WITH {_RANKED_SQL} SELECT representation, query_id,
min(neighbor_rank) FILTER (relevant)::INT AS first_rank FROM ranked GROUP BY 1, 2""")
def first_relevant_rank(spark, sf):
    return evaluation.first_relevant(_ranked(spark, sf), by=["representation"])


@query(f"""WITH {_RANKED_SQL}, s AS (SELECT representation, query_id,
bool_or(relevant AND neighbor_rank = 1) AS top1, count(*) FILTER (relevant) AS matches
FROM ranked GROUP BY 1, 2)
SELECT representation, CASE WHEN top1 AND matches >= 3 THEN 'success' WHEN matches = 0 THEN 'failure'
ELSE 'mixed' END AS case_type, count(*) AS n FROM s GROUP BY 1, 2""")
def case_types(spark, sf):
    per = _ranked(spark, sf).groupBy("representation", "query_id").agg(
        F.min_by("relevant", "neighbor_rank").alias("top1"),
        F.count_if("relevant").alias("matches"),
    )
    return per.groupBy("representation", labels.case_type("top1", "matches").alias("case_type")).agg(
        F.count("*").alias("n")
    )


# ---------------------------------------------------------------- clustering
_AGREEMENT_SQL = f"""{PREDICTIONS_SQL},
cells AS (SELECT representation, task, y_true, y_pred, count(*)::DOUBLE AS n FROM predictions GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY representation, task, y_true) AS a,
             sum(n) OVER (PARTITION BY representation, task, y_pred) AS b,
             sum(n) OVER (PARTITION BY representation, task) AS t FROM cells),
la AS (SELECT DISTINCT representation, task, y_true, a, t FROM m),
lb AS (SELECT DISTINCT representation, task, y_pred, b, t FROM m),
ha AS (SELECT representation, task, -sum(a / t * ln(a / t)) AS h, sum(a * (a - 1) / 2) AS c
       FROM la GROUP BY 1, 2),
hb AS (SELECT representation, task, -sum(b / t * ln(b / t)) AS h, sum(b * (b - 1) / 2) AS c
       FROM lb GROUP BY 1, 2),
mi AS (SELECT representation, task, sum(n / t * ln(t * n / (a * b))) AS mi, sum(n * (n - 1) / 2) AS same_cell,
              max(t * (t - 1) / 2) AS pairs FROM m GROUP BY 1, 2),
agreement AS (
  SELECT mi.representation, mi.task, round(mi / ((ha.h + hb.h) / 2), 9) AS nmi,
         round((same_cell - ha.c * hb.c / pairs) / ((ha.c + hb.c) / 2 - ha.c * hb.c / pairs), 9) AS ari
  FROM mi JOIN ha USING (representation, task) JOIN hb USING (representation, task)),
clustering AS (
  SELECT representation, max(nmi) FILTER (task = 'category') AS nmi_category,
         max(ari) FILTER (task = 'category') AS ari_category,
         max(nmi) FILTER (task = 'sentiment') AS nmi_sentiment,
         max(ari) FILTER (task = 'sentiment') AS ari_sentiment FROM agreement GROUP BY 1)"""


@query(f"WITH {_AGREEMENT_SQL} SELECT * FROM agreement")
def cluster_agreement(spark, sf):
    df = evaluation.cluster_agreement(
        predictions(spark, sf), "y_true", "y_pred", ["representation", "task"]
    )
    return reports.rounded(df, ["nmi", "ari"], 9)


def _clustering(spark, sf) -> DataFrame:
    df = evaluation.cluster_agreement(
        predictions(spark, sf), "y_true", "y_pred", ["representation", "task"]
    )
    df = reports.rounded(df, ["nmi", "ari"], 9)
    pick = lambda v, t: F.max(F.when(F.col("task") == t, F.col(v))).alias(f"{v}_{t}")
    return df.groupBy("representation").agg(
        pick("nmi", "category"), pick("ari", "category"),
        pick("nmi", "sentiment"), pick("ari", "sentiment"),
    )


@query(f"WITH {_AGREEMENT_SQL} SELECT * FROM clustering")
def clustering_table(spark, sf):
    return _clustering(spark, sf)


# ---------------------------------------------------------------- comparison
_UNIFIED_SQL = f"""{_SCORES_SQL},
{_RETRIEVAL_SQL[len(PREDICTIONS_SQL) + 1:]},
{_AGREEMENT_SQL[len(PREDICTIONS_SQL) + 1:]},
unified AS (
  SELECT s.representation, s.macro_f1 AS sentiment_test_macro_f1, s.accuracy AS sentiment_test_accuracy,
         c.macro_f1 AS category_test_macro_f1, c.accuracy AS category_test_accuracy,
         r.recall_at_10, r.mrr_at_10, k.nmi_category, k.ari_category, k.nmi_sentiment, k.ari_sentiment
  FROM (SELECT * FROM classification WHERE split = 'test' AND task = 'sentiment') s
  JOIN (SELECT * FROM classification WHERE split = 'test' AND task = 'category') c USING (representation)
  LEFT JOIN retrieval r USING (representation) LEFT JOIN clustering k USING (representation))"""


def _unified(spark, sf) -> DataFrame:
    return evaluation.unified_table(
        _classification(spark, sf), _retrieval(spark, sf), _clustering(spark, sf)
    )


@query(f"WITH {_UNIFIED_SQL} SELECT * FROM unified ORDER BY category_test_macro_f1 DESC, representation")
def unified_comparison(spark, sf):
    return _unified(spark, sf)


@query(f"""WITH {_UNIFIED_SQL} SELECT representation, round(mrr_at_10, 4) AS mrr_at_10,
round(nmi_category, 4) AS nmi_category FROM unified ORDER BY unified.mrr_at_10 DESC, representation""")
def metric_snapshot(spark, sf):
    return evaluation.snapshot(_unified(spark, sf), ["mrr_at_10", "nmi_category"])


@query(f"""WITH {_UNIFIED_SQL} SELECT representation, mrr_at_10 AS retrieval_mrr_at_10,
recall_at_10 AS retrieval_recall_at_10, nmi_category AS clustering_nmi_category,
ari_category AS clustering_ari_category,
rank() OVER (ORDER BY mrr_at_10 DESC)::INT AS retrieval_mrr_rank,
rank() OVER (ORDER BY nmi_category DESC)::INT AS clustering_nmi_rank FROM unified""")
def metric_comparison(spark, sf):
    return evaluation.side_by_side(_retrieval(spark, sf), _clustering(spark, sf))


def _best_sql(task: str, column: str) -> str:
    return (
        f"SELECT '{task}' AS task, representation, {column} AS value FROM unified "
        f"QUALIFY row_number() OVER (ORDER BY {column} DESC, representation) = 1"
    )


_WINNERS = {
    "category": "category_test_macro_f1", "sentiment": "sentiment_test_macro_f1",
    "retrieval": "mrr_at_10", "clustering": "nmi_category",
}


@query(f"WITH {_UNIFIED_SQL} " + " UNION ALL ".join(f"({_best_sql(t, c)})" for t, c in _WINNERS.items()))
def task_winners(spark, sf):
    return evaluation.winners(_unified(spark, sf), _WINNERS)


@query(f"""WITH {_UNIFIED_SQL}, w AS (
  SELECT (SELECT representation FROM unified ORDER BY mrr_at_10 DESC, representation LIMIT 1) AS first_winner,
         (SELECT representation FROM unified ORDER BY nmi_category DESC, representation LIMIT 1) AS second_winner)
SELECT *, first_winner = second_winner AS same_winner,
CASE WHEN first_winner = second_winner THEN first_winner || ' wins both tasks'
     ELSE 'retrieval: ' || first_winner || ', clustering: ' || second_winner END AS statement FROM w""")
def same_winner_statement(spark, sf):
    return evaluation.winner_statement(
        _unified(spark, sf), ("retrieval", "mrr_at_10"), ("clustering", "nmi_category")
    )


# ---------------------------------------------------------------- insights
@query()
def latent_insights(spark, sf):
    from lexiloom.operators import outliers
    from lexiloom.plans.tables import labelled_vectors

    rows = labelled_vectors(spark, sf)
    purity = latent_space.row_purity(rows, "row_id", ["main_category"], 10)
    per_class = reports.group_stats(purity, "main_category", "purity_main_category")
    facts = latent_space.insights(
        purity, per_class.withColumnRenamed("main_category", "class"),
        outliers.top_outliers(rows, "row_id", trees=200),
        latent_space.centroid_similarity(rows, "main_category", normalize=True),
        _unified(spark, sf),
    )
    return latent_space.insight_sentences(facts)
