"""End-to-end jobs, each composed of the operators.

A job returns DataFrames; the ``write_…`` functions put them into a folder. Where
a later step reads an earlier one several times, the earlier one is written once
and read back, which also cuts its lineage.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import schema as sc
from lexiloom.config import EmbeddingConfig
from lexiloom.functions import hashing, mlvectors
from lexiloom.functions import text as tx
from lexiloom.functions import vectors as vec
from lexiloom.operators import (
    cases, evaluation, latent_semantic, latent_space, models, neighbours, outliers, pooling,
    reports, sampling, shaping, splits, word_vectors,
)
from lexiloom.operators import vocabulary as vb
from lexiloom.operators.lookups import small_side
from lexiloom.session import side_by_side
from lexiloom.sources import readers, writers


# ---------------------------------------------------------------- sampling
def sample_reviews(
    spark: SparkSession, sources: Mapping[str, str], n: int, out: str, seed=42,
    key: tuple[str, ...] | None = None,
) -> DataFrame:
    """Per source file an exact sample with labels, all sources combined.

    Rows are drawn by a hash of ``key``, by default of all their columns, so that records differing in
    any column are drawn apart, whatever the order of the file.

    ``sources`` maps a category to its JSON-lines path. A finished combined table
    is reused, and so is each finished source sample.
    """
    def one(category: str, path: str) -> DataFrame:
        def compute() -> DataFrame:
            rows = readers.read_jsonl_lenient(
                spark, path, partitions=spark.sparkContext.defaultParallelism
            )
            keyed = rows.withColumn("_key", hashing.record_key(*(key or rows.columns)))
            kept = shaping.keep_available(sampling.exact(keyed, n, "_key", seed), sc.SAMPLE_COLUMNS)
            return shaping.with_sentiment(shaping.with_category(kept, category))

        return readers.read_through(spark, f"{out}/{category}_sample_{n}", compute)

    def combined() -> DataFrame:
        return shaping.union_tables(*[one(c, p) for c, p in sources.items()])

    table = readers.read_through(spark, f"{out}/reviews_sample_{n}", combined)
    return shaping.with_sentiment(shaping.rename_category(table))


@dataclass(frozen=True)
class HashSample:
    accepted: DataFrame
    log: DataFrame
    final: DataFrame
    local: DataFrame


def record_hash_key() -> Column:
    """What identifies a review for sampling."""
    return hashing.record_key("user_id", "parent_asin", "timestamp", "rating", "text")


def hash_sample(
    raw: DataFrame, target: int, oversample: float = 1.25, local_rows: int = 200_000, seed=42,
    strict: bool = True, category: str = "category",
) -> HashSample:
    """Oversample every category by record hash, remove duplicates, trim to ``target`` rows.

    The acceptance step is row-local once the category sizes are known.
    """
    rows = shaping.shape_review(raw)
    sizes = sampling.keep_probability(rows, category, target, oversample)
    kept = hashing.keep_with_probability(record_hash_key(), F.col("keep_prob"))
    marked = (
        rows.join(small_side(sizes.select(category, "keep_prob")), category)
        .withColumn("_kept", (F.col("text_len") > 0) & kept)
    )
    log = sampling.sampling_log(marked, category, "_kept", "keep_prob")
    accepted = marked.filter("_kept").drop("_kept", "keep_prob")
    subset = ["user_id", "parent_asin", "timestamp", "text"]
    whole = hashing.record_key(category, *subset)
    rest = [F.col(c) for c in ("rating", "title", "helpful_vote", "verified_purchase")]
    unique = reports.drop_duplicates(accepted, [category, *subset], rest)
    keyed = unique.withColumn("_key", whole)
    final = sampling.exact_after_dedup(keyed, target, category, "_key", seed, strict)
    local = sampling.exact(final, local_rows, "_key", f"{seed}-local")
    return HashSample(accepted, log, final.drop("_key"), local.drop("_key"))


def write_hash_sample(sample: HashSample, out: str) -> None:
    writers.write_chunks(sample.accepted, f"{out}/accepted")
    writers.write_table(sample.final, f"{out}/final", "category")
    writers.write_table(sample.local, f"{out}/local")
    writers.write_report_csv(sample.log, f"{out}/sampling_log")


# ---------------------------------------------------------------- preparation
def audit(df: DataFrame) -> dict[str, DataFrame]:
    """Category counts, sentiment shares and missing values."""
    return {
        "categories": reports.value_counts(df, "main_category"),
        "sentiments": reports.value_shares(df, "sentiment"),
        "missing": reports.missing_values(df),
    }


def prepare(
    df: DataFrame, test: float = 0.15, val: float = 0.15, seed=42, keep=(),
    exact_groups: bool = False,
) -> DataFrame:
    """Label, clean, drop empty text, split by group, keep the output columns.

    One chain of row-local steps without a shuffle; ``exact_groups`` fixes the
    number of groups per split, for which two cut points are found first.
    """
    rows = shaping.with_sentiment(shaping.rename_category(df))
    if "cleaned_text" in df.columns or "text" not in df.columns:
        rows = shaping.drop_empty_text(shaping.with_cleaned_text(rows))
    else:  # told before the cleaning, which the filter and the cut points would repeat
        rows = rows.filter(tx.keeps_any("text"))
    split = splits.by_group_exact if exact_groups else splits.by_group
    rows = shaping.with_cleaned_text(split(rows, test=test, val=val, seed=seed))
    return shaping.keep_available(rows, [*keep, *sc.SPLIT_COLUMNS, "split"])


def split_summary(prepared: DataFrame) -> DataFrame:
    """Rows per split in one row."""
    return prepared.agg(*[
        F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "val", "test")
    ])


def write_prepared(df: DataFrame, out: str, **options) -> DataFrame:
    writers.write_table(prepare(df, **options), f"{out}/splits", "split")
    written = readers.read_table(df.sparkSession, f"{out}/splits")
    summary = split_summary(written).withColumns({
        "columns": F.array(*[F.lit(c) for c in written.columns if c != "split"]),
        "seed": F.lit(str(options.get("seed", 42))),
    })
    writers.write_summary_json(summary, f"{out}/split_summary")
    return written


# ---------------------------------------------------------------- baselines
@dataclass(frozen=True)
class Baselines:
    """``rows``: the weights as written, for a broadcast vocabulary a row of lists per document; ``tfidf``: in long form."""

    vocabulary: DataFrame
    tfidf: DataFrame
    rows: DataFrame
    terms: int
    model: latent_semantic.LatentModel
    lsa: DataFrame
    summary: DataFrame


def build_baselines(
    df: DataFrame, out: str, key: str = "row_id", text: str = "cleaned_text",
    settings: vb.TermSettings = vb.TermSettings(), n_components: int = 300,
) -> Baselines:
    """TF-IDF and latent semantic vectors of all splits, fitted on train."""
    spark = df.sparkSession
    docs = readers.text_or_empty(df, text, "_text")
    train = docs.filter(F.col("split") == "train")
    fitted = vb.with_term_ids(vb.fit_vocabulary(train, "_text", settings))
    writers.write_table(fitted, f"{out}/vocabulary")
    vocabulary = readers.read_table(spark, f"{out}/vocabulary")
    terms = vocabulary.count()
    # A vocabulary that is broadcast gives a row of lists per document; these are written and shuffled as they are.
    short = settings.max_features is not None and settings.max_features <= vb.BROADCAST_TERMS
    weigh = vb.sparse_documents if short else vb.tfidf_weights
    writers.write_table(weigh(docs, vocabulary, key, "_text", settings, ["split"]), f"{out}/tfidf")
    rows = readers.read_table(spark, f"{out}/tfidf")
    tfidf = vb.long_weights(rows, key, ["split"]) if short else rows
    model = latent_semantic.fit(rows.filter(F.col("split") == "train"), key, terms, n_components)
    writers.write_table(model.components, f"{out}/components")
    projected = latent_semantic.project(rows, model, key)
    zero = F.array_repeat(F.lit(0.0), model.size).cast("array<float>")
    lsa = (
        docs.select(key, *[c for c in sc.VECTOR_META_COLUMNS if c in docs.columns], "split")
        .join(projected, key, "left")
        .withColumn("vector", F.coalesce("vector", zero))
    )
    writers.write_table(lsa, f"{out}/lsa", "split")
    lsa = readers.read_table(spark, f"{out}/lsa")
    explained = latent_semantic.explained_variance(
        tfidf.filter(F.col("split") == "train"), lsa.filter(F.col("split") == "train"), train.count()
    )
    summary = vb.feature_summary(vocabulary, docs).withColumns({
        "components": F.lit(model.size),
        "explained_variance_ratio_sum": F.round(explained.select("ratio").scalar(), 4),
    })
    writers.write_summary_json(summary, f"{out}/summary")
    return Baselines(vocabulary, tfidf, rows, terms, model, lsa, summary)


def tfidf_features(tfidf: DataFrame, docs: DataFrame, terms: int, key: str = "row_id") -> DataFrame:
    """One sparse ML vector per document; documents without known terms get a zero vector."""
    rows = vb.sparse_rows(tfidf, key)
    none = F.array().cast("array<int>"), F.array().cast("array<double>")
    return docs.join(rows, key, "left").withColumn(
        "features",
        mlvectors.sparse(F.coalesce("indices", none[0]), F.coalesce("weights", none[1]), terms),
    )


def baseline_probes(
    df: DataFrame, out: str, key: str = "row_id", train_rows: int | None = None,
    val_rows: int | None = None, n_components: int = 100,
    settings: vb.TermSettings = vb.TermSettings(max_features=25_000), seed=42,
    task: str = "main_category", examples: int = 5, **fit_options,
) -> tuple[DataFrame, DataFrame]:
    """Probes on all train and val rows: (scores, first errors of the latent probe).

    Vocabulary, document frequencies and the latent space are fitted on all train rows; ``train_rows`` and ``val_rows``, if
    given, bound by a sample what the probes see, nothing else. Predictions are written, and scores and errors come from the written ones.
    """
    rows = shaping.drop_missing(df, ["cleaned_text", "sentiment", "main_category"])
    writers.write_table(rows, f"{out}/rows")
    rows = readers.read_table(df.sparkSession, f"{out}/rows")
    base = build_baselines(rows, out, key, "cleaned_text", settings, n_components)
    parts = {"train": train_rows, "val": val_rows}
    sampled = shaping.union_tables(*[
        rows.filter(F.col("split") == s) if n is None
        else sampling.exact(rows.filter(F.col("split") == s), n, key, seed) for s, n in parts.items()
    ])
    writers.write_table(sampled, f"{out}/sample")
    sampled = readers.read_table(df.sparkSession, f"{out}/sample")
    dense = base.lsa.drop("split", *sc.VECTOR_META_COLUMNS).join(sampled, key).withColumn(
        "features", mlvectors.dense("vector")
    )
    frames = {"tfidf": tfidf_features(base.rows, sampled, base.terms, key), "lsa": dense}
    tasks = {"sentiment": "sentiment", "category": "main_category"}
    scores = models.probe_grid(frames, tasks, key=key, folder=f"{out}/predictions", **fit_options)
    name = next(n for n, label in tasks.items() if label == task)
    found = readers.read_table(df.sparkSession, f"{out}/predictions").filter(
        (F.col("representation") == "lsa") & (F.col("task") == name) & (F.col("split") == "val"))
    scored = found.select(key, "y_true", "y_pred").join(sampled.drop("split"), key)
    return scores, evaluation.first_errors(scored, key, examples)


# ---------------------------------------------------------------- word vectors
def train_word_vectors(
    df: DataFrame, cfg: EmbeddingConfig, out: str, key: str = "row_id", partitions: int | None = None
) -> dict[str, DataFrame]:
    """Scope, cap, fit, export vectors of all splits, sanity tables, summary.

    Training uses as many partitions as the session has cores unless told otherwise.
    """
    spark = df.sparkSession
    partitions = partitions or spark.sparkContext.defaultParallelism
    parts = []
    for split, cap in (("train", cfg.max_train_rows), ("val", cfg.max_vector_rows),
                       ("test", cfg.max_vector_rows)):
        rows, used = readers.load_split(df.filter(F.col("split") == split), cfg.text_column)
        rows = shaping.category_scope(
            rows, cfg.categories, cfg.category_column, cfg.strict_categories, split
        )
        rows = rows.withColumn(cfg.text_column, F.col(used))
        parts.append(sampling.row_cap(rows, cap, key, cfg.seed))
    scoped = shaping.union_tables(*parts)
    model = word_vectors.fit(scoped.filter("split = 'train'"), cfg, partitions)
    writers.save_model(model, f"{out}/{cfg.model_name}.model")
    writers.write_table(word_vectors.word_table(model), f"{out}/words")
    words = readers.read_table(spark, f"{out}/words")
    vectors = word_vectors.document_vectors(scoped, words, cfg, key)
    writers.write_table(vectors, f"{out}/vectors", "split")
    vectors = readers.read_table(spark, f"{out}/vectors")
    val = vectors.filter("split = 'val'")
    document_checks = word_vectors.document_neighbours(
        val, cfg.sanity_top_k, cfg.sanity_doc_pool_size, key=key, text=cfg.text_column,
        category=cfg.category_column, seed=cfg.seed,
    )
    exports = pooling.coverage(vectors, by=["split"])
    word_checks = word_vectors.word_neighbours(words, cfg.sanity_words, cfg.sanity_top_k)
    summary = exports.agg(
        F.collect_list(F.struct("split", "rows", "nonzero_rows", "coverage")).alias("exports")
    ).withColumns({
        "model_name": F.lit(cfg.model_name),
        "vocabulary_size": words.agg(F.count("*")).scalar(),
    })
    writers.write_summary_json(summary, f"{out}/summary")
    return {
        "words": words, "vectors": vectors, "exports": exports, "summary": summary,
        "word_checks": word_checks, "document_checks": document_checks,
    }


# ---------------------------------------------------------------- evaluation
def _with_sparse(info: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Every row of ``info`` with its sparse vector; a text without a known term has an empty one."""
    return info.join(rows, key, "left").withColumns({
        f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in rows.schema if f.name != key
    })


def evaluate(
    labels: DataFrame, dense: Mapping[str, DataFrame], sparse: Mapping[str, tuple[DataFrame, int]],
    key: str = "row_id", k: int = 10, query_limit: int | None = None, n_clusters: int = 4,
    seed: int = 42, out: str | None = None, **fit_options,
) -> dict[str, DataFrame]:
    """Classification, retrieval and clustering of every representation, and the joint table.

    With ``out`` the probes' predictions, the flagged neighbours and the clusters are written there, and the scores are
    those of the written tables.

    ``labels`` holds key, split, main_category and sentiment. ``dense`` maps a
    representation to (key, vector) rows, ``sparse`` to TF-IDF weights, long or as lists, and
    the number of terms; sparse rows are clustered on their sparse vectors.
    """
    info = labels.select(key, "split", "main_category", "sentiment")
    payload = ["db_category", "db_sentiment"]
    named = info.withColumnsRenamed({"main_category": "db_category", "sentiment": "db_sentiment"})
    queries = info.filter("split = 'val'")
    if query_limit is not None:
        queries = queries.orderBy(key).limit(query_limit)
    database = named.filter("split = 'train'")
    frames, ranked, clustered = {}, {}, {}  # the last two as steps, which run side by side with the probes
    for name, vectors in dense.items():
        rows = info.join(vectors.select(key, "vector"), key)
        frames[name] = rows.withColumn("features", mlvectors.dense("vector"))
        ranked[name] = partial(
            neighbours.nearest, queries.join(vectors.select(key, "vector"), key),
            database.join(vectors.select(key, "vector"), key),
            k, key, key, payload=payload, exclude_self=False,
        )
        clustered[name] = partial(models.kmeans_clusters, rows.filter("split = 'val'"), n_clusters, seed=seed)
    def kept(table: DataFrame, folder: str) -> DataFrame:
        if out is None:
            return table
        return readers.read_table(table.sparkSession, writers.write_table(table, f"{out}/{folder}"))

    for name, (weights, terms) in sparse.items():
        # Read by the probes, as queries and corpus, and by the clustering: joined and shuffled once.
        rows = kept(_with_sparse(info, vb.sparse_rows(weights, key), key), f"sparse/{name}")
        frames[name] = rows.withColumn("features", mlvectors.sparse("indices", "weights", terms))
        asked = rows.filter("split = 'val'")
        ranked[name] = partial(
            neighbours.nearest_sparse, asked if query_limit is None else asked.orderBy(key).limit(query_limit),
            rows.filter("split = 'train'").withColumnsRenamed({"main_category": "db_category", "sentiment": "db_sentiment"}),
            k, key, key, payload=payload, exclude_self=False,
        )
        # TF-IDF rows already have unit length.
        clustered[name] = partial(models.kmeans_features, frames[name].filter("split = 'val'"), n_clusters, seed=seed)

    own = queries.select(F.col(key).alias("query_id"), "main_category", "sentiment")
    match = (F.col("main_category") == F.col("db_category")) & (
        F.col("sentiment") == F.col("db_sentiment")
    )

    def retrieved(name: str) -> DataFrame:
        flagged = kept(ranked[name]().join(own, "query_id").withColumn("relevant", match), f"neighbours/{name}")
        return evaluation.retrieval_scores(flagged, k).withColumn("representation", F.lit(name))

    def grouped(name: str) -> DataFrame:
        labelled = kept(clustered[name]().select(key, "main_category", "sentiment", "cluster"), f"clusters/{name}")
        return evaluation.clustering_report(labelled).withColumn("representation", F.lit(name))

    classification, *rest = side_by_side([
        partial(models.probe_grid, frames, {"sentiment": "sentiment", "category": "main_category"}, key=key,
                folder=f"{out}/predictions" if out else None, **fit_options),
        *[partial(retrieved, name) for name in ranked], *[partial(grouped, name) for name in clustered],
    ])
    retrieval, clustering = rest[:len(ranked)], rest[len(ranked):]
    retrieval = shaping.union_tables(*retrieval)
    clustering = shaping.union_tables(*clustering)
    return {
        "classification": classification,
        "retrieval": retrieval,
        "clustering": clustering,
        "unified": evaluation.unified_table(classification, retrieval, clustering, k),
    }


def write_evaluation(
    tables: Mapping[str, DataFrame], out: str, settings: Mapping[str, object] | None = None
) -> dict[str, DataFrame]:
    """CSV tables; the joint table is built from the written ones. ``settings`` of the run go beside them as JSON."""
    spark = next(iter(tables.values())).sparkSession
    done = {}
    for name in ("classification", "retrieval", "clustering"):
        path = writers.write_report_csv(tables[name], f"{out}/{name}")
        done[name] = readers.read_csv(spark, path, tables[name].schema)
    done["unified"] = evaluation.unified_table(
        done["classification"], done["retrieval"], done["clustering"]
    )
    writers.write_report_csv(done["unified"], f"{out}/unified")
    if settings is not None:
        row = spark.createDataFrame([(json.dumps(settings, sort_keys=True, default=str),)], "settings string")
        writers.write_summary_json(row, f"{out}/settings")
    return done


# ---------------------------------------------------------------- reports
def retrieval_report(
    unified: DataFrame, retrieval: DataFrame, clustering: DataFrame, document_checks: DataFrame,
    rows: DataFrame | Mapping[str, DataFrame], key: str = "row_id", n_clusters: int = 4,
    sample: int | None = None, settings: vb.TermSettings = vb.TermSettings(**vb.KEYWORD_SETTINGS),
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Comparison, case studies and cluster summaries.

    ``rows`` is labelled text with vectors, or one such table for each representation; the
    cluster tables then cover all of them, named in ``representation``, and the first one supplies
    the texts of the cases. ``sample`` bounds the rows that are clustered; by default all are.
    """
    spaces = rows if isinstance(rows, Mapping) else {"word2vec": rows}
    table = cases.neighbour_table(document_checks, next(iter(spaces.values())), key)
    summary = cases.case_summary(table)
    found = {"clusters": [], "composition": [], "sentiment_composition": []}
    for name, vectors in spaces.items():
        pool = vectors if sample is None else sampling.exact(vectors, sample, key, seed)
        clustered = models.kmeans_clusters(shaping.drop_zero_vectors(pool), n_clusters, seed=seed)
        tables = {
            "clusters": latent_space.cluster_summary(clustered, key, settings=settings),
            "composition": reports.crosstab_shares(clustered, "cluster", "main_category"),
            "sentiment_composition": reports.crosstab_shares(clustered, "cluster", "sentiment"),
        }
        for report, made in tables.items():
            found[report].append(made.withColumn("representation", F.lit(name)))
    return {
        "comparison": evaluation.side_by_side(retrieval, clustering),
        "winners": evaluation.winners(
            unified, {"retrieval": "mrr_at_10", "clustering": "nmi_category"}
        ),
        "cases": summary,
        "examples": cases.case_rows(table, cases.representative_cases(summary)),
        **{report: shaping.union_tables(*made) for report, made in found.items()},
    }


def write_report(tables: Mapping[str, DataFrame], out: str) -> dict[str, DataFrame]:
    """Every table of a report, written and read again, so that none computes the lineage of another anew."""
    return {name: readers.read_table(t.sparkSession, writers.write_table(t, f"{out}/{name}")) for name, t in tables.items()}


def long_form(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All tables of a report in one: (report, row as JSON)."""
    out = None
    for name, table in tables.items():
        one = table.select(F.lit(name).alias("report"), F.to_json(F.struct("*")).alias("row"))
        out = one if out is None else out.unionByName(one)
    return out


def latent_report(
    rows: DataFrame, unified: DataFrame, key: str = "row_id", k: int = 10, top_outliers: int = 20,
    trees: int = 200, cap: int = 2500, seed: int = 42, text: str = "cleaned_text",
    representation: str = "word2vec",
) -> dict[str, DataFrame]:
    """Projection, purity, outliers, example neighbours, centroids, insights."""
    label = "main_category"
    unit = rows.withColumn("vector", vec.normalize("vector"))
    purity = latent_space.row_purity(unit, key, [label, "sentiment"], k)
    per_class = reports.group_stats(purity, label, f"purity_{label}").withColumnRenamed(
        label, "class"
    )
    odd = outliers.decision_score(
        outliers.top_outliers(unit, key, "vector", top_outliers, trees, seed=seed)
    )
    similarity = latent_space.centroid_similarity(unit, label, normalize=True)
    shown = sampling.exact_per_group(unit, 1, key, [label], seed)
    chosen = shaping.union_tables(
        shown.select(key, "vector"),
        odd.orderBy("anomaly_score", key).limit(3).select(key, "vector"),
    ).dropDuplicates([key])
    return {
        "plane": latent_space.plane_projection(unit, key, label, cap, seed=seed, carry=["sentiment"]),
        "purity": purity,
        "per_class": per_class,
        "outliers": odd.drop("vector"),
        "examples": neighbours.nearest(chosen, unit, 5, key, key, payload=[label, "sentiment", text]),
        "centroids": similarity,
        "insights": latent_space.insights(
            purity, per_class, odd, similarity, unified, label, representation
        ),
    }
