import math

import pytest

from lexiloom.operators import evaluation, latent_space, reports
from lexiloom.operators.cases import case_rows, case_summary, neighbour_table, representative_cases


def frame(spark, pairs, names="y_true string, y_pred string"):
    return spark.createDataFrame(pairs, names)


def scores(spark, pairs):
    return tuple(evaluation.classification_scores(frame(spark, pairs)).collect()[0])


def test_classification_edge_cases(spark):
    assert scores(spark, [("a", "a"), ("b", "b")]) == (1.0, 1.0)
    assert scores(spark, [("a", "b"), ("b", "a")]) == (0.0, 0.0)
    # "c" is only predicted: it counts as a class with F1 0
    acc, f1 = scores(spark, [("a", "a"), ("a", "c"), ("b", "b")])
    assert acc == pytest.approx(2 / 3) and f1 == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert scores(spark, [("a", "a"), ("a", "a")]) == (1.0, 1.0)


def agreement(spark, pairs):
    return tuple(evaluation.cluster_agreement(frame(spark, pairs, "l string, cluster int"), "l").collect()[0])


def test_cluster_agreement_limits(spark):
    perfect = [("a", 1), ("a", 1), ("b", 0), ("c", 2)]
    nmi, ari = agreement(spark, perfect)
    assert nmi == pytest.approx(1.0) and ari == pytest.approx(1.0)
    assert agreement(spark, [("a", 0), ("a", 0)]) == (1.0, 1.0)
    nmi, ari = agreement(spark, [("a", 0), ("b", 0), ("a", 0)])
    assert nmi == pytest.approx(0.0, abs=1e-12) and ari == pytest.approx(0.0, abs=1e-12)
    independent = [(x, c) for x in "ab" for c in (0, 1) for _ in range(50)]
    nmi, ari = agreement(spark, independent)
    assert abs(nmi) < 1e-12 and abs(ari) < 0.02


def test_cluster_agreement_by_hand(spark):
    # contingency [[2, 1], [0, 3]]
    pairs = [("a", 0), ("a", 0), ("a", 1), ("b", 1), ("b", 1), ("b", 1)]
    nmi, ari = agreement(spark, pairs)
    mi = 2 / 6 * math.log(6 * 2 / (3 * 2)) + 1 / 6 * math.log(6 / (3 * 4)) + 3 / 6 * math.log(6 * 3 / (3 * 4))
    ha, hb = math.log(2), -(1 / 3 * math.log(1 / 3) + 2 / 3 * math.log(2 / 3))
    assert nmi == pytest.approx(mi / ((ha + hb) / 2))
    both, a, b, t = 1 + 3, 6, 1 + 6, 15
    assert ari == pytest.approx((both - a * b / t) / ((a + b) / 2 - a * b / t))


def test_retrieval_scores(spark):
    ranked = spark.createDataFrame(
        [(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False), (3, 1, True), (4, 11, True)],
        "query_id int, neighbor_rank int, relevant boolean")
    row = evaluation.retrieval_scores(ranked, 10).collect()[0]
    assert row["queries"] == 3 and row["recall_at_10"] == pytest.approx(2 / 3)
    assert row["mrr_at_10"] == pytest.approx((0.5 + 0 + 1) / 3)
    empty = evaluation.retrieval_scores(ranked.limit(0), 10).collect()[0]
    assert empty["queries"] == 0 and empty["recall_at_10"] is None


def test_confusion_pairs_and_errors(spark):
    df = frame(spark, [("a", "b")] * 3 + [("b", "a")] * 3 + [("a", "c"), ("a", "a")])
    got = [tuple(r) for r in evaluation.confusion_pairs(df, top_n=2).collect()]
    assert got == [("a", "b", 3), ("b", "a", 3)]
    counts = {r["y_true"]: r["count"] for r in
              evaluation.label_counts(evaluation.errors_only(df), "y_true").collect()}
    assert counts == {"a": 4, "b": 3}
    none = frame(spark, [("a", "a")]).selectExpr("1 AS row_id", "'t' AS cleaned_text", "y_true", "y_pred")
    assert evaluation.misclassified_examples(none, "row_id").count() == 0


def test_misclassified_examples_are_in_key_order(spark):
    df = spark.range(300).selectExpr(
        "id AS row_id", "concat('t', id) AS cleaned_text", "'a' AS y_true",
        "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS y_pred")
    got = [r["row_id"] for r in evaluation.misclassified_examples(df, "row_id", n=20).collect()]
    assert len(got) == 20 and got == sorted(got) and all(i % 2 for i in got)


@pytest.fixture(scope="module")
def tables(spark):
    cls = spark.createDataFrame(
        [(r, t, s, a, f) for r, a, f in [("tfidf", .9, .8), ("lsa", .7, .6)]
         for t in ("category", "sentiment") for s in ("val", "test")],
        "representation string, task string, split string, accuracy double, macro_f1 double")
    ret = spark.createDataFrame([("lsa", .9, .5, 10)],
                                "representation string, recall_at_10 double, mrr_at_10 double, queries long")
    clu = spark.createDataFrame(
        [("tfidf", .1, .2, .3, .4), ("lsa", .1, .1, .1, .1)],
        "representation string, nmi_category double, ari_category double, nmi_sentiment double, ari_sentiment double")
    return cls, ret, clu


def test_unified_table_keeps_rows_without_retrieval(tables):
    rows = evaluation.unified_table(*tables).collect()
    assert [r["representation"] for r in rows] == ["tfidf", "lsa"]
    assert rows[0]["mrr_at_10"] is None and rows[1]["mrr_at_10"] == 0.5


def test_winners_and_ranks(tables):
    unified = evaluation.unified_table(*tables)
    got = {r["task"]: r["representation"] for r in
           evaluation.winners(unified, {"retrieval": "mrr_at_10", "category": "category_test_macro_f1",
                                        "clustering": "nmi_category"}).collect()}
    assert got == {"retrieval": "lsa", "category": "tfidf", "clustering": "lsa"}
    line = evaluation.winner_statement(
        unified, ("retrieval", "mrr_at_10"), ("category", "category_test_macro_f1")).collect()[0]
    assert line["same_winner"] is False and line["statement"] == "retrieval: lsa, category: tfidf"
    tied = evaluation.metric_rank(tables[2], "nmi_category", "r").collect()
    assert [r["r"] for r in tied] == [1, 1]


def test_snapshot_rounds_and_sorts(tables):
    unified = evaluation.unified_table(*tables)
    rows = evaluation.snapshot(unified, ["mrr_at_10"]).collect()
    assert [r["representation"] for r in rows] == ["lsa", "tfidf"]


def test_cases(spark):
    rows = spark.createDataFrame(
        [(i, "x" if i < 5 else "y", "positive", f"text {i}") for i in range(10)],
        "row_id long, main_category string, sentiment string, cleaned_text string")
    ranked = spark.createDataFrame(
        [(0, r, n, 1.0) for r, n in enumerate([1, 2, 3, 8, 9], 1)]
        + [(5, r, n, 1.0) for r, n in enumerate([1, 6, 2, 3, 4], 1)]
        + [(7, r, n, 1.0) for r, n in enumerate([0, 1, 2, 3, 4], 1)],
        "query_id long, neighbor_rank int, neighbor_id long, score double")
    table = neighbour_table(ranked, rows)
    summary = case_summary(table)
    got = {r["query_id"]: (r["top1_joint_match"], r["joint_matches"], r["case_type"])
           for r in summary.collect()}
    assert got == {0: (True, 3, "success"), 5: (False, 1, "mixed"), 7: (False, 0, "failure")}
    assert representative_cases(summary).count() == 3
    assert case_rows(table, representative_cases(summary)).count() == 15


def test_insights(spark, tables):
    purity = spark.createDataFrame(
        [("a", 1.0), ("a", 0.5), ("b", 0.2)], "main_category string, purity_main_category double")
    per = reports.group_stats(purity, "main_category", "purity_main_category").withColumnRenamed(
        "main_category", "class")
    odd = spark.createDataFrame([("b",), ("b",), ("a",)], "main_category string")
    sim = spark.createDataFrame(
        [("a", "b", .9), ("b", "a", .9), ("a", "a", 1.0), ("a", "c", .1)],
        "main_category_a string, main_category_b string, cosine double")
    facts = latent_space.insights(purity, per, odd, sim, evaluation.unified_table(*tables),
                                  representation="lsa")
    got = {r["fact"]: (r["subject"], round(r["value"], 3)) for r in facts.collect()}
    assert got == {
        "average_purity": ("main_category", 0.567), "best_class": ("a", 0.75), "worst_class": ("b", 0.2),
        "dominant_outlier_class": ("b", 0.667), "closest_centroids": ("a & b", 0.9),
        "category_macro_f1": ("lsa", 0.6), "sentiment_macro_f1": ("lsa", 0.6)}
    lines = latent_space.insight_sentences(facts).collect()
    assert "best_class: a (0.750)" in {r["sentence"] for r in lines}
