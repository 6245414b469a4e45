import gzip
import json

import pytest
from pyspark.sql import functions as F

from lexiloom import schema as sc
from lexiloom.config import EmbeddingConfig
from lexiloom.operators import vocabulary as vb
from lexiloom.plans import jobs
from lexiloom.session import cut_lineage, shared_dir
from lexiloom.sources import readers, writers
from lexiloom.streaming import ingest


def lines(path, records, gz=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    text = "\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n"
    with (gzip.open if gz else open)(path, "wt", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def review(i, **over):
    return {"rating": float(i % 5 + 1), "title": f"t{i}", "text": f"Good <b>item</b> number {i}!",
            "parent_asin": f"p{i % 30}", "user_id": f"u{i}", "timestamp": 1700000000000 + i,
            "helpful_vote": i, "verified_purchase": i % 2 == 0, **over}


def test_jsonl_strict_and_lenient(spark, tmp_path):
    good = lines(tmp_path / "a.jsonl", [review(1), "", review(2)])
    assert readers.read_jsonl(spark, good).count() == 2
    bad = lines(tmp_path / "b.jsonl.gz", [review(1), "{broken", "", review(2), "not json"], gz=True)
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, bad).collect()
    lenient = readers.read_jsonl_lenient(spark, bad, partitions=4)
    assert lenient.count() == 2 and lenient.columns == sc.RAW_REVIEW.fieldNames()
    assert lenient.select("title").count() == 2 and lenient.rdd.getNumPartitions() == 4


def test_text_column_fallback(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "i int, text string")
    loaded, used = readers.load_split(df, "cleaned_text")
    assert used == "text" and loaded.count() == 1
    assert [r["text"] for r in readers.text_or_empty(df).orderBy("i").collect()] == ["", "x"]
    with pytest.raises(ValueError, match="no text column"):
        readers.load_split(df.select("i"))


def test_read_through_computes_once_and_after_an_interrupted_write(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "t")
    (tmp_path / "t").mkdir()  # leftovers without a success marker
    assert readers.read_through(spark, path, compute).count() == 3
    assert readers.read_through(spark, path, compute).count() == 3
    assert len(calls) == 1


def test_sinks(spark, tmp_path):
    df = spark.range(1000).withColumn("split", F.when(F.col("id") < 10, "val").otherwise("train"))
    writers.write_table(df, f"{tmp_path}/p", "split")
    assert (tmp_path / "p" / "split=val").is_dir()
    writers.write_chunks(df.coalesce(1), f"{tmp_path}/c", 300)
    assert len(list((tmp_path / "c").glob("*.parquet"))) == 4
    path = writers.write_report_csv(df.limit(3), f"{tmp_path}/r")
    assert readers.read_csv(spark, path, df.schema).count() == 3
    row = spark.createDataFrame([(1, [("a", 2)])], "n int, parts array<struct<k:string,v:int>>")
    path = writers.write_summary_json(row, f"{tmp_path}/s")
    assert readers.read_json_document(spark, path, row.schema).collect() == row.collect()


def test_shared_folder_and_lineage(spark):
    assert shared_dir(spark, "x") != shared_dir(spark, "x")
    assert cut_lineage(spark.range(5)).count() == 5


def test_sample_reviews_job(spark, tmp_path):
    sources = {
        c: lines(tmp_path / f"{c}.jsonl.gz", [review(i + 1000 * k) for i in range(200)] + ["{bad"], gz=True)
        for k, c in enumerate(("Electronics", "Sports_and_Outdoors"))
    }
    out = str(tmp_path / "out")
    a = jobs.sample_reviews(spark, sources, 50, out)
    counts = {r["main_category"]: r["count"] for r in a.groupBy("main_category").count().collect()}
    assert counts == {"Electronics": 50, "Sports_and_Outdoors": 50}
    assert {"sentiment", "main_category", "text"} <= set(a.columns) and "user_id" not in a.columns
    again = jobs.sample_reviews(spark, {c: "/nowhere" for c in sources}, 50, out)
    assert sorted(r["text"] for r in again.collect()) == sorted(r["text"] for r in a.collect())


def test_hash_sample_job(spark, tmp_path):
    raw = [dict(review(i), category="A" if i % 3 else "B") for i in range(900)]
    raw += raw[:50] + [dict(review(5000), text=None, category="A")]
    df = spark.read.schema(
        ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sc.RAW_REVIEW) + ", category string"
    ).json(lines(tmp_path / "r.jsonl", raw))
    assert df.count() == 951
    made = jobs.hash_sample(df, 200, local_rows=100)
    per = {r["category"]: r["count"] for r in made.final.groupBy("category").count().collect()}
    assert per == {"A": 200, "B": 200} and made.local.count() == 100
    log = {r["category"]: r for r in made.log.collect()}
    assert log["A"]["seen"] + log["B"]["seen"] == 951 and 0.2 < log["A"]["keep_prob"] < 0.5
    assert made.accepted.filter("text_len = 0").count() == 0
    jobs.write_hash_sample(made, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/final")).count() == 400
    with pytest.raises(ValueError, match="fewer than"):
        jobs.hash_sample(df, 5000)


def test_stream_accepts_the_same_rows_as_the_batch(spark, tmp_path):
    for part in range(3):
        lines(tmp_path / "in" / f"{part}.jsonl", [review(i) for i in range(part * 100, part * 100 + 100)])
    stream = ingest.read_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    run = ingest.write_stream(
        ingest.label_clean_split(ingest.accept(stream, "Electronics", 0.5)),
        str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = ingest.accept(readers.read_jsonl(spark, str(tmp_path / "in")), "Electronics", 0.5)
    assert sorted(r["user_id"] for r in got.collect()) == sorted(r["user_id"] for r in batch.collect())
    assert 100 < got.count() < 200 and {"sentiment", "cleaned_text", "split"} <= set(got.columns)


@pytest.fixture(scope="module")
def corpus(spark):
    """Two categories with their own words, products spread over splits."""
    words = {"a": "battery charger cable power", "b": "hair skin cream soft"}
    rows = []
    for i in range(240):
        c = "ab"[i % 2]
        w = words[c].split()
        rows.append((i, f"{w[i % 4]} {w[(i + 1) % 4]} {w[(i // 4) % 4]} item good", float(1 + i % 5),
                     f"p{i % 40}", c))
    df = spark.createDataFrame(
        rows, "row_id long, text string, rating double, parent_asin string, category string")
    prepared = jobs.prepare(df, keep=["row_id"], exact_groups=True)
    path = writers.write_table(prepared, shared_dir(spark, "corpus"))
    return spark.read.parquet(path)


def test_prepare(corpus, spark, tmp_path):
    assert corpus.columns == ["row_id", *sc.SPLIT_COLUMNS, "split"]
    assert {r["split"] for r in corpus.select("split").distinct().collect()} == {"train", "val", "test"}
    report = jobs.audit(corpus)
    assert {r["main_category"]: r["count"] for r in report["categories"].collect()} == {"a": 120, "b": 120}
    df = spark.createDataFrame([("<b>", 1.0, "p", "c"), ("ok", 1.0, "p", "c")],
                               "text string, rating double, parent_asin string, category string")
    written = jobs.write_prepared(df, str(tmp_path / "w"))
    assert written.count() == 1
    summary = readers.read_json_document(spark, str(tmp_path / "w/split_summary")).collect()[0]
    assert summary["train_rows"] + summary["val_rows"] + summary["test_rows"] == 1


def test_learned_jobs_end_to_end(spark, corpus, tmp_path):
    st = vb.TermSettings(max_features=200, min_df=2)
    base = jobs.build_baselines(corpus, str(tmp_path / "base"), settings=st, n_components=5)
    summary = base.summary.collect()
    assert len(summary) == 3 and summary[0]["features"] == base.terms and base.lsa.count() == 240
    assert 0 < summary[0]["explained_variance_ratio_sum"] <= 1

    cfg = EmbeddingConfig(vector_size=8, min_count=1, epochs=2, categories=("a", "b"),
                          sanity_words=("battery", "nope"))
    made = jobs.train_word_vectors(corpus, cfg, str(tmp_path / "w2v"))
    exports = {r["split"]: r for r in made["exports"].collect()}
    assert sum(r["rows"] for r in exports.values()) == 240 and exports["val"]["coverage"] == 1.0
    assert {r["word"]: r["found"] for r in made["word_checks"].collect()} == {"battery": True, "nope": False}

    tables = jobs.evaluate(
        corpus, {"lsa": base.lsa, "word2vec": made["vectors"]}, {"tfidf": (base.tfidf, base.terms)},
        n_clusters=2, max_iter=30)
    done = jobs.write_evaluation(tables, str(tmp_path / "eval"))
    unified = {r["representation"]: r for r in done["unified"].collect()}
    assert set(unified) == {"tfidf", "lsa", "word2vec"}
    assert unified["tfidf"]["category_test_macro_f1"] == 1.0
    assert all(0 <= r["mrr_at_10"] <= r["recall_at_10"] <= 1 for r in unified.values())

    val = made["vectors"].filter("split = 'val'")
    small = vb.TermSettings(max_features=100, min_df=1)
    report = jobs.retrieval_report(done["unified"], done["retrieval"], done["clustering"],
                                   made["document_checks"], val, n_clusters=2, settings=small)
    assert report["comparison"].count() == 3 and report["winners"].count() == 2
    assert report["cases"].count() == 3 and report["clusters"].count() == 2
    shares = report["composition"].select(F.col("a") + F.col("b")).collect()
    assert all(r[0] == pytest.approx(1.0) for r in shares)

    latent = jobs.latent_report(val, done["unified"], trees=20, top_outliers=5)
    assert latent["outliers"].count() == 5 and latent["insights"].count() == 7
    assert latent["purity"].count() == val.count() and latent["examples"].count() > 0
    assert latent["plane"].count() > 0 and latent["centroids"].count() == 4


def test_baseline_probes_job(corpus, tmp_path):
    scores, errors = jobs.baseline_probes(
        corpus, str(tmp_path), settings=vb.TermSettings(max_features=100, min_df=2), n_components=4,
        max_iter=20)
    assert scores.count() == 4 and errors.count() <= 5


def test_baseline_probes_see_all_train_rows_unless_told_otherwise(spark, corpus, tmp_path, monkeypatch):
    drawn = []

    def exact(rows, n, *rest):
        drawn.append(n)
        return rows.orderBy("row_id").limit(n)

    monkeypatch.setattr(jobs.sampling, "exact", exact)
    options = {"settings": vb.TermSettings(max_features=100, min_df=2), "n_components": 4, "max_iter": 5}
    jobs.baseline_probes(corpus, str(tmp_path / "all"), **options)
    seen = spark.read.parquet(str(tmp_path / "all/sample")).groupBy("split").count()
    assert not drawn and dict(seen.collect()) == dict(corpus.filter("split <> 'test'").groupBy("split").count().collect())
    jobs.baseline_probes(corpus, str(tmp_path / "some"), train_rows=60, **options)
    assert drawn == [60] and spark.read.parquet(str(tmp_path / "some/sample")).filter("split = 'train'").count() == 60


def test_report_of_several_representations_in_long_form(spark, corpus, tmp_path):
    cfg = EmbeddingConfig(vector_size=8, min_count=1, epochs=1, categories=("a", "b"), sanity_words=("battery",))
    made = jobs.train_word_vectors(corpus, cfg, str(tmp_path / "w2v"))
    val = made["vectors"].filter("split = 'val'")
    scores = spark.createDataFrame([("x", 0.5, 0.4), ("y", 0.6, 0.3)], "representation string, recall_at_10 double, mrr_at_10 double")
    clusters = spark.createDataFrame([("x", 0.1, 0.1, 0.1, 0.1), ("y", 0.2, 0.2, 0.2, 0.2)],
                                     "representation string, nmi_category double, ari_category double, nmi_sentiment double, ari_sentiment double")
    report = jobs.retrieval_report(
        scores.join(clusters, "representation"), scores, clusters, made["document_checks"],
        {"word2vec": val, "turned": val}, n_clusters=2, settings=vb.TermSettings(max_features=100, min_df=1))
    assert {r["representation"] for r in report["clusters"].collect()} == {"word2vec", "turned"}
    counts = {r["report"]: r["count"] for r in jobs.long_form(report).groupBy("report").count().collect()}
    assert set(counts) == set(report) and counts["winners"] == 2 and counts["clusters"] == 4


def test_evaluation_shuffles_sparse_rows_once(spark, corpus, tmp_path, monkeypatch):
    st = vb.TermSettings(max_features=200, min_df=2)
    base = jobs.build_baselines(corpus, str(tmp_path / "base"), settings=st, n_components=4)
    calls, sparse_rows = [], vb.sparse_rows
    monkeypatch.setattr(vb, "sparse_rows", lambda *a, **b: calls.append(a) or sparse_rows(*a, **b))
    tables = jobs.evaluate(corpus, {"lsa": base.lsa}, {"tfidf": (base.rows, base.terms)}, n_clusters=2, max_iter=5, out=str(tmp_path / "out"))
    assert len(calls) == 1 and spark.read.parquet(str(tmp_path / "out/sparse/tfidf")).count() == 240
    assert {r["representation"] for r in tables["unified"].collect()} == {"lsa", "tfidf"}
    limited = jobs.evaluate(corpus, {}, {"tfidf": (base.rows, base.terms)}, n_clusters=2, max_iter=5, query_limit=7, out=str(tmp_path / "some"))
    assert limited["retrieval"].count() == 1
    assert spark.read.parquet(str(tmp_path / "some/neighbours/tfidf")).select("query_id").distinct().count() == 7


def test_texts_that_cleaning_empties_are_told_before_it(spark):
    from lexiloom.functions import text as tx

    texts = ["<b>", "", None, "!?", "<a>x</a>", "É", "K", "<1", "a", " 7 ", "< >é<br/>", "<i>9"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", tx.keeps_any("text").alias("any"), tx.clean_text("text").alias("cleaned")).collect():
        assert r["any"] == (r["cleaned"] != ""), r
