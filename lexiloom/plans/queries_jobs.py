"""Whole jobs over the given tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lexiloom.config import EmbeddingConfig
from lexiloom.functions import mlvectors
from lexiloom.functions import vectors as vec
from lexiloom.operators import (
    evaluation, latent_semantic, models, shaping, splits,
)
from lexiloom.operators import vocabulary as vb
from lexiloom.plans import jobs
from lexiloom.plans.queries_data import _SHAPED_SQL, _raw_events
from lexiloom.plans.registry import query
from lexiloom.plans.tables import (
    REVIEWS_SQL, VECTORS_SQL, clean_sql, hash_sql, reviews, sentiment_sql, split_sql, terms_sql, unit_sql,
    vectors,
)
from lexiloom.session import shared_dir
from lexiloom.sources import readers, writers


# ---------------------------------------------------------------- sampling
_JOB_KEY = "concat_ws('||', coalesce(text, ''), coalesce(parent_asin, ''))"


@query(f"""WITH {REVIEWS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY main_category
ORDER BY {hash_sql(_JOB_KEY)}, {_JOB_KEY}) AS n FROM reviews)
SELECT main_category, parent_asin, rating, {sentiment_sql('rating')} AS sentiment,
       md5(text) AS digest FROM r WHERE n <= 100""")
def sampled_reviews_job(spark, sf):
    """All categories from their own gzip JSON-lines folders, 100 rows each, combined."""
    out = shared_dir(spark, "sample")
    rows = reviews(spark, sf).select("main_category", "text", "parent_asin", "rating")
    sources = {}
    for name in ("de", "en", "es", "fr"):
        part = rows.filter(F.col("main_category") == name).drop("main_category")
        sources[name] = writers.write_jsonl(part, f"{out}/raw/{name}", gzip=True)
    df = jobs.sample_reviews(spark, sources, 100, out, key=("text", "parent_asin"))
    return df.select(
        "main_category", "parent_asin", "rating", "sentiment", F.md5("text").alias("digest")
    )


_RECORD = "concat_ws('||', coalesce(user_id, ''), coalesce(parent_asin, ''), coalesce(timestamp::VARCHAR, ''), {r}coalesce(text, ''))"
_HASHED_SQL = f"""{_SHAPED_SQL},
probs AS (SELECT category, least(1.0::DOUBLE, 625.0::DOUBLE / count(*)) AS keep_prob FROM shaped GROUP BY 1),
marked AS (
  SELECT s.*, p.keep_prob, text_len > 0 AND {unit_sql('md5(' + _RECORD.format(r="coalesce(rating::VARCHAR, ''), ") + ')')} < p.keep_prob AS kept
  FROM shaped s JOIN probs p USING (category)),
uniq AS (SELECT *, concat_ws('||', category, user_id, parent_asin, timestamp::VARCHAR, text) AS k FROM marked WHERE kept
  QUALIFY row_number() OVER (PARTITION BY category, user_id, parent_asin, timestamp, text
                             ORDER BY rating, title, helpful_vote, verified_purchase) = 1)"""


def _hash_sample(spark, sf):
    return jobs.hash_sample(_raw_events(spark, sf), target=500, strict=False)


@query(f"""WITH {_HASHED_SQL} SELECT row_id, category, rating, text FROM uniq
QUALIFY row_number() OVER (PARTITION BY category ORDER BY {hash_sql('k')}, k) <= 500""")
def hash_sample_job(spark, sf):
    return _hash_sample(spark, sf).final.select("row_id", "category", "rating", "text")


@query(f"""WITH {_HASHED_SQL} SELECT category, count(*) AS seen, count(*) FILTER (kept) AS kept,
max(keep_prob) AS keep_prob FROM marked GROUP BY 1""")
def hash_sample_log(spark, sf):
    return _hash_sample(spark, sf).log


@query(f"""WITH {_SHAPED_SQL} SELECT row_id, text FROM shaped WHERE text_len > 0 AND
{unit_sql('md5(' + _RECORD.format(r="coalesce(rating::VARCHAR, ''), ") + ')')} < 0.4""")
def streamed_acceptance(spark, sf):
    """The acceptance step as a file stream that stops when all files are read."""
    from lexiloom.streaming import ingest

    base = shared_dir(spark, "stream")
    typed = shaping.shape_review(_raw_events(spark, sf)).select(
        "row_id", "rating", "title", "text", "parent_asin", "user_id", "timestamp",
        "helpful_vote", "verified_purchase",
    )
    writers.write_jsonl(typed, f"{base}/in")
    rows = ingest.read_stream(spark, f"{base}/in", typed.schema)
    run = ingest.write_stream(
        ingest.accept(rows, "events", 0.4), f"{base}/out", f"{base}/checkpoint"
    )
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("row_id", "text")


# ---------------------------------------------------------------- preparation
_PREPARED_SQL = f"""{REVIEWS_SQL}, c AS (
  SELECT row_id, rating, text, parent_asin, main_category, {sentiment_sql('rating')} AS sentiment,
         {clean_sql('text')} AS cleaned_text, {split_sql('parent_asin')} AS split FROM reviews),
prepared AS (SELECT * FROM c WHERE length(cleaned_text) > 0)"""


@query(f"WITH {_PREPARED_SQL} SELECT * FROM prepared")
def prepared_dataset(spark, sf):
    return jobs.prepare(reviews(spark, sf), keep=["row_id"])


@query(f"WITH {_PREPARED_SQL} SELECT split, count(*) AS rows, count(DISTINCT parent_asin) AS products "
       "FROM prepared GROUP BY 1")
def written_dataset(spark, sf):
    df = jobs.write_prepared(reviews(spark, sf), shared_dir(spark, "prepared"), keep=["row_id"])
    return df.groupBy("split").agg(
        F.count("*").alias("rows"), F.count_distinct("parent_asin").alias("products")
    )


@query(f"""WITH {REVIEWS_SQL}, a AS (SELECT *, {sentiment_sql('rating')} AS sentiment FROM reviews)
SELECT 'category' AS what, main_category AS value, count(*)::DOUBLE AS amount FROM a GROUP BY 1, 2
UNION ALL SELECT 'sentiment', sentiment, count(*)::DOUBLE / (SELECT count(*) FROM a) FROM a GROUP BY 1, 2
UNION ALL SELECT 'missing', 'rating', count(*) FILTER (rating IS NULL)::DOUBLE FROM a
UNION ALL SELECT 'missing', 'text', count(*) FILTER (text IS NULL)::DOUBLE FROM a""")
def dataset_audit(spark, sf):
    parts = jobs.audit(shaping.with_sentiment(reviews(spark, sf)))

    def flat(df, what, value, amount):
        return df.select(F.lit(what).alias("what"), F.col(value).alias("value"),
                         F.col(amount).cast("double").alias("amount"))

    missing = parts["missing"].filter(F.col("column").isin("rating", "text"))
    return (
        flat(parts["categories"], "category", "main_category", "count")
        .unionByName(flat(parts["sentiments"], "sentiment", "sentiment", "share"))
        .unionByName(flat(missing, "missing", "column", "missing"))
    )


# ---------------------------------------------------------------- learned representations
_TERMS = vb.TermSettings(max_features=5_000)
_W2V = EmbeddingConfig(
    vector_size=32, min_count=10, epochs=1, min_review_tokens=5, categories=("en", "fr", "de", "es"),
    sanity_words=("the", "der", "les", "zzzz"),
)


def _prepared(spark, sf):
    """Prepared rows, written once: several steps of the learned jobs read them."""
    out = shared_dir(spark, "rows")
    rows = jobs.prepare(reviews(spark, sf), keep=["row_id"], exact_groups=True)
    writers.write_table(rows, out)
    return readers.read_table(spark, out)


@query()
def baseline_features_job(spark, sf):
    base = jobs.build_baselines(
        _prepared(spark, sf), shared_dir(spark, "baselines"), settings=_TERMS, n_components=20
    )
    return base.summary


_PARTS_SQL = f"""{_PREPARED_SQL},
g AS (SELECT parent_asin, row_number() OVER (ORDER BY {hash_sql('parent_asin')}, parent_asin) AS r, count(*) OVER () AS n
      FROM (SELECT DISTINCT parent_asin FROM prepared)),
t AS (SELECT *, ceil(0.15::DOUBLE * n) AS nt FROM g),
v AS (SELECT *, ceil((0.15::DOUBLE / (1.0::DOUBLE - 0.15::DOUBLE)) * (n - nt)) AS nv FROM t),
parts AS (SELECT p.row_id, p.main_category, p.cleaned_text,
    CASE WHEN r <= nt THEN 'test' WHEN r <= nt + nv THEN 'val' ELSE 'train' END AS split
  FROM prepared p JOIN v ON p.parent_asin IS NOT DISTINCT FROM v.parent_asin)"""


@query(f"""WITH {_PARTS_SQL}, train AS (SELECT * FROM parts WHERE split = 'train'),
{terms_sql('train', 'row_id', 'cleaned_text')},
vocabulary AS (SELECT term FROM terms GROUP BY 1 HAVING count(DISTINCT row_id) >= 5
  AND count(DISTINCT row_id) <= 0.95 * (SELECT count(*) FROM train))
SELECT split, count(*) AS rows, (SELECT least(count(*), {_TERMS.max_features}) FROM vocabulary) AS features,
       20 AS components, true AS explains_a_share FROM parts GROUP BY 1""")
def baseline_features_facts(spark, sf):
    """Rows of every split, vocabulary size and rank of the features job; the explained share is one."""
    base = jobs.build_baselines(
        _prepared(spark, sf), shared_dir(spark, "baselines"), settings=_TERMS, n_components=20
    )
    return base.summary.select(
        "split", "rows", "features", "components",
        F.col("explained_variance_ratio_sum").between(0.0, 1.0).alias("explains_a_share"),
    )


@query(f"""WITH {VECTORS_SQL}, squares AS (
  SELECT len(vector) AS d, list_sum(list_transform(vector, lambda x: x * x)) AS q FROM vectors)
SELECT max(d) AS values, round(sum(q), 6) AS energy, count(*) AS rows, count(*) AS lengths_kept FROM squares""")
def singular_value_facts(spark, sf):
    """At full rank the squared singular values add up to the table's, and the basis keeps every row's length."""
    rows = vectors(spark, sf)
    dims = rows.select(F.max(F.size("vector"))).first()[0]
    long = rows.select("row_id", F.posexplode(vec.as_double("vector")).alias("term_id", "weight"))
    model = latent_semantic.fit(long, "row_id", dims, dims)
    turned = latent_semantic.project(long, model, "row_id", "turned")
    length = vec.norm("vector")
    return rows.join(turned, "row_id").agg(
        F.lit(model.size).cast("long").alias("values"),
        F.round(F.lit(sum(x * x for x in model.singular_values)), 6).alias("energy"),
        F.count("*").alias("rows"),
        F.count_if(F.abs(vec.norm("turned") - length) <= 1e-5 * length).alias("lengths_kept"),
    )


_LABELLED_PARTS_SQL = _PARTS_SQL.replace("p.main_category, p.cleaned_text,", "p.main_category, p.sentiment, p.cleaned_text,")


def _agree(scores, predictions, by):
    """Whether reported accuracies are those of the written predictions, by plain counting."""
    counted = predictions.groupBy(*by).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("_a"), F.count("*").alias("rows"))
    return scores.join(counted, list(by)).select(
        *by, "rows", (F.abs(F.col("accuracy") - F.col("_a")) < 1e-9).alias("accuracy_agrees"),
        (F.col("accuracy").between(0, 1) & F.col("macro_f1").between(0, 1)).alias("in_range"))


_PROBE_FACTS_SQL = """SELECT representation, task, split, count(*) AS rows, true AS accuracy_agrees, true AS in_range
FROM (SELECT * FROM parts WHERE sentiment IS NOT NULL AND main_category IS NOT NULL) p, (VALUES {names}) r(representation), (VALUES ('sentiment'), ('category')) t(task)
WHERE split IN ({splits}) GROUP BY ALL"""


@query(f"WITH {_LABELLED_PARTS_SQL} {_PROBE_FACTS_SQL.format(names="('tfidf'), ('lsa')", splits="'val'")}")
def baseline_probes_job(spark, sf):
    """Rows each probe was asked, and whether its scores are those of its written predictions."""
    out = shared_dir(spark, "probes")
    scores, _ = jobs.baseline_probes(_prepared(spark, sf), out, settings=_TERMS, n_components=20, max_iter=50)
    return _agree(scores, spark.read.parquet(f"{out}/predictions"), ("representation", "task", "split"))


@query(f"""WITH {_LABELLED_PARTS_SQL} SELECT least(5, count(*)) >= 0 AS bounded, true AS errors_only, true AS of_val FROM parts WHERE split = 'val'""")
def baseline_first_errors(spark, sf):
    """The first errors of the latent probe are errors, of val rows, five at most."""
    rows = _prepared(spark, sf)
    _, errors = jobs.baseline_probes(rows, shared_dir(spark, "probes"), settings=_TERMS, n_components=20, max_iter=20)
    val = rows.filter("split = 'val'").select("row_id", F.lit(True).alias("_val"))
    return errors.join(val, "row_id", "left").agg(
        (F.count("*") <= 5).alias("bounded"), F.coalesce(F.min(F.col("y_true") != F.col("y_pred")), F.lit(True)).alias("errors_only"),
        F.coalesce(F.min(F.coalesce("_val", F.lit(False))), F.lit(True)).alias("of_val"))


_CATEGORIES = ", ".join(f"'{c}'" for c in _W2V.categories)


@query(f"""WITH {_PARTS_SQL}, cut AS (
  SELECT split, list_filter(string_split(cleaned_text, ' '), lambda x: x <> '') AS w FROM parts
  WHERE main_category IN ({_CATEGORIES})),
words AS (SELECT split, CASE WHEN len(w) >= {_W2V.min_review_tokens} THEN w ELSE [] END AS w FROM cut),
known AS (SELECT term FROM (SELECT unnest(w) AS term FROM words WHERE split = 'train') GROUP BY 1
  HAVING count(*) >= {_W2V.min_count}),
hits AS (SELECT split, list_has_any(w, (SELECT list(term) FROM known)) AS hit FROM words)
SELECT split, count(*) AS rows, count(*) FILTER (hit) AS nonzero_rows,
       count(*) FILTER (hit)::DOUBLE / count(*) AS coverage FROM hits GROUP BY 1""")
def word_vectors_job(spark, sf):
    made = jobs.train_word_vectors(_prepared(spark, sf), _W2V, shared_dir(spark, "words"))
    return made["exports"]


@query()
def svm_probe(spark, sf):
    rows = splits.by_group(vectors(spark, sf), "row_id").withColumn(
        "features", mlvectors.dense("vector")
    )
    model = models.fit_svm_probe(rows.filter("split = 'train'"), "label", max_iter=50)
    scored = models.predict(model, rows.filter("split <> 'train'"), "label")
    return evaluation.classification_scores(scored, by=["split"])


@query()
def logistic_probe(spark, sf):
    rows = splits.by_group(vectors(spark, sf), "row_id").withColumn(
        "features", mlvectors.dense("vector")
    )
    model = models.fit_logistic_probe(rows.filter("split = 'train'"), "label", max_iter=100)
    scored = models.predict(model, rows.filter("split <> 'train'"), "label")
    return evaluation.classification_scores(scored, by=["split"])


def _evaluated(spark, sf):
    rows = _prepared(spark, sf)
    base = jobs.build_baselines(rows, shared_dir(spark, "baselines"), settings=_TERMS, n_components=20)
    words = jobs.train_word_vectors(rows, _W2V, shared_dir(spark, "words"))
    out = shared_dir(spark, "evaluation")
    tables = jobs.evaluate(
        rows, {"lsa": base.lsa, "word2vec": words["vectors"]}, {"tfidf": (base.rows, base.terms)},
        max_iter=50, out=f"{out}/details",
    )
    return rows, words, jobs.write_evaluation(tables, out, {"terms": _TERMS, "word2vec": _W2V}), out


@query(f"""WITH {_LABELLED_PARTS_SQL}, probes AS ({_PROBE_FACTS_SQL.format(names="('tfidf'), ('lsa'), ('word2vec')", splits="'val', 'test'")}),
names AS (SELECT unnest(['tfidf', 'lsa', 'word2vec']) AS representation), n AS (SELECT count(*) AS n FROM parts WHERE split = 'val'),
scoped AS (SELECT count(*) AS n FROM parts WHERE split = 'val' AND main_category IN ('en', 'fr', 'de', 'es'))
SELECT representation, task, split, CASE WHEN representation = 'word2vec' THEN rows - rows + (SELECT count(*) FROM parts q WHERE q.split = p.split
  AND q.sentiment IS NOT NULL AND q.main_category IN ('en', 'fr', 'de', 'es')) ELSE rows END AS rows, accuracy_agrees AS agrees FROM probes p
UNION ALL SELECT representation, 'retrieval', 'val', CASE WHEN representation = 'word2vec' THEN (SELECT n FROM scoped) ELSE (SELECT n FROM n) END, true FROM names
UNION ALL SELECT representation, 'clustering', 'val', CASE WHEN representation = 'word2vec' THEN (SELECT n FROM scoped) ELSE (SELECT n FROM n) END, true FROM names""")
def evaluation_job(spark, sf):
    """Rows behind every score, and whether scores recomputed from the written tables by plain counting are those reported."""
    _, _, tables, out = _evaluated(spark, sf)
    read = lambda kind, name: spark.read.parquet(f"{out}/details/{kind}/{name}")
    probes = _agree(tables["classification"], spark.read.parquet(f"{out}/details/predictions"), ("representation", "task", "split"))
    facts = [probes.select("representation", "task", "split", "rows", F.col("accuracy_agrees").alias("agrees"))]
    for name in ("tfidf", "lsa", "word2vec"):
        first = read("neighbours", name).groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("neighbor_rank"))).alias("r"))
        mine = first.agg(F.count("*").alias("rows"), F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))).alias("m"))
        told = tables["retrieval"].filter(F.col("representation") == name).first()["mrr_at_10"]
        facts.append(mine.select(
            F.lit(name).alias("representation"), F.lit("retrieval").alias("task"), F.lit("val").alias("split"), "rows",
            (F.abs(F.col("m") - F.lit(told)) < 1e-9).alias("agrees")))
        # Mutual information of clusters and categories over their mean entropy, from the counts of the written clusters.
        cells = read("clusters", name).groupBy("cluster", "main_category").agg(F.count("*").alias("n")).collect()
        told = tables["clustering"].filter(F.col("representation") == name).first()
        total = sum(r["n"] for r in cells)
        facts.append(spark.createDataFrame(
            [(name, "clustering", "val", total, abs(_nmi([(r[0], r[1], r[2]) for r in cells]) - told["nmi_category"]) < 1e-9)],
            "representation string, task string, split string, rows long, agrees boolean"))
    return shaping.union_tables(*facts)


def _nmi(cells):
    """Normalised mutual information of a small table of counts."""
    total, a, b = sum(n for *_, n in cells), {}, {}
    for x, y, n in cells:
        a[x], b[y] = a.get(x, 0) + n, b.get(y, 0) + n
    entropy = lambda d: -sum(n / total * math.log(n / total) for n in d.values())
    shared = sum(n / total * math.log(n * total / (a[x] * b[y])) for x, y, n in cells)
    mean = (entropy(a) + entropy(b)) / 2
    return shared / mean if mean else 1.0


@query()
def retrieval_report_job(spark, sf):
    """Every table of the report."""
    _, words, tables, out = _evaluated(spark, sf)
    report = jobs.retrieval_report(
        tables["unified"], tables["retrieval"], tables["clustering"],
        words["document_checks"], words["vectors"].filter("split = 'val'"),
    )
    return jobs.long_form(jobs.write_report(report, f"{out}/report"))


@query()
def latent_report_job(spark, sf):
    """Every table of the report."""
    _, words, tables, out = _evaluated(spark, sf)
    report = jobs.latent_report(words["vectors"].filter("split = 'val'"), tables["unified"])
    return jobs.long_form(jobs.write_report(report, f"{out}/report"))
