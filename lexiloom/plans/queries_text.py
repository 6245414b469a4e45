"""Queries over text cleaning, tokens, vocabulary and TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.config import EmbeddingConfig
from lexiloom.functions import labels
from lexiloom.functions import text as tx
from lexiloom.operators import evaluation, latent_space, neighbours, reports, shaping, splits
from lexiloom.operators import vocabulary as vb
from lexiloom.plans.registry import query
from lexiloom.plans.tables import (
    DOCUMENTS_SQL, REVIEWS_SQL, STOP_WORDS, clean_sql, documents, reviews, sentiment_sql,
    split_sql, table, terms_sql,
)
from lexiloom.session import cut_lineage


# ---------------------------------------------------------------- cleaning
@query(f"SELECT doc_id, {clean_sql('text')} AS cleaned_text FROM documents")
def cleaned_documents(spark, sf):
    return documents(spark, sf).select("doc_id", "cleaned_text")


@query(f"SELECT page_id, {clean_sql('html')} AS cleaned_text FROM pages")
def cleaned_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.clean_text("html").alias("cleaned_text"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g'))) AS digest "
       "FROM documents")
def collapsed_whitespace(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(tx.collapse_whitespace("text")).alias("digest")
    )


@query("SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents")
def stripped_accents(spark, sf):
    from lexiloom.session import ship_package

    ship_package(spark)
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(tx.strip_accents("text")).alias("digest")
    )


@query("SELECT doc_id, substr(text, 1, 180) AS preview, length(text)::BIGINT AS chars FROM documents")
def text_previews(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tx.preview("text", 180).alias("preview"),
        F.char_length("text").cast("long").alias("chars"),
    )


# ---------------------------------------------------------------- tokens
_TOKENS_SQL = (
    "list_filter(string_split({t}, ' '), lambda x: x <> '')"
)


@query(f"""WITH {DOCUMENTS_SQL}, t AS (SELECT doc_id, {_TOKENS_SQL.format(t='cleaned_text')}[1:256]
AS w FROM docs), m AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN w ELSE [] END AS w FROM t)
SELECT doc_id, len(w)::BIGINT AS n, array_to_string(w, ' ') AS joined FROM m""")
def tokens_cut_and_minimum(spark, sf):
    """The cut to 256 tokens is what the tokenizer does; the text itself is read whole."""
    df = documents(spark, sf).select("doc_id", tx.tokenize("cleaned_text", 5, 256).alias("w"))
    return df.select(
        "doc_id", F.size("w").cast("long").alias("n"), F.array_join("w", " ").alias("joined")
    )


_CONFIGURED = EmbeddingConfig.build(
    {"data": {"min_review_tokens": 2, "max_review_tokens": 900}, "word2vec": {"window": 4}}, {"max_review_tokens": 64}, {"min_review_tokens": 7})


@query(f"""WITH {DOCUMENTS_SQL}, t AS (SELECT doc_id, {_TOKENS_SQL.format(t='cleaned_text')}[1:64] AS w FROM docs)
SELECT doc_id, len(w)::BIGINT AS n, array_to_string(w, ' ') AS joined FROM t WHERE len(w) >= 7""")
def configured_tokens(spark, sf):
    """Tokens by settings of three layers: the run's come first, then the experiment's, then the project's."""
    df = shaping.tokenized(documents(spark, sf), "cleaned_text", _CONFIGURED.min_review_tokens, _CONFIGURED.max_review_tokens)
    return df.select("doc_id", F.size("tokens").cast("long").alias("n"), F.array_join("tokens", " ").alias("joined"))


@query(f"""WITH c AS (SELECT conv_id, turn, {_TOKENS_SQL.format(t=clean_sql('text'))} AS w
FROM conversations) SELECT conv_id, turn, len(w)::BIGINT AS n FROM c WHERE len(w) >= 12""")
def nonempty_token_lists(spark, sf):
    df = shaping.with_cleaned_text(table(spark, sf, "conversations"))
    return shaping.tokenized(df, "cleaned_text", min_tokens=12).select(
        "conv_id", "turn", F.size("tokens").cast("long").alias("n")
    )


@query(f"""WITH {DOCUMENTS_SQL}, {terms_sql('docs', 'doc_id', 'cleaned_text')}
SELECT doc_id, count(*) AS terms, count(DISTINCT term) AS distinct_terms,
       min(term) AS first_term, max(term) AS last_term FROM terms GROUP BY 1""")
def ngrams_per_document(spark, sf):
    return vb.term_summary(documents(spark, sf).select("doc_id", "cleaned_text"), "doc_id", tx.terms("cleaned_text"))


@query(f"""WITH {DOCUMENTS_SQL}, {terms_sql('docs', 'doc_id', 'cleaned_text', stop=True)}
SELECT term, count(*) AS n FROM words, unnest(w) AS u(term) GROUP BY 1""")
def words_without_stop_words(spark, sf):
    df = documents(spark, sf).select(
        F.explode(tx.terms("cleaned_text", 1, 1, STOP_WORDS)).alias("term")
    )
    return df.groupBy("term").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- vocabulary
_STATS_SQL = """
stats AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM terms GROUP BY 1)"""


@query(f"""WITH {DOCUMENTS_SQL}, {terms_sql('docs', 'doc_id', 'cleaned_text')}, {_STATS_SQL}
SELECT term, df, cf FROM stats""")
def term_frequencies(spark, sf):
    return vb.term_statistics(documents(spark, sf))


def _vocabulary_sql(min_df: int, max_df: float, cap: int, docs: str = "docs") -> str:
    return f"""{_STATS_SQL},
vocabulary AS (
  SELECT term, df, cf, ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf
  FROM stats, (SELECT count(*) AS n FROM {docs})
  WHERE df >= {min_df} AND df <= {max_df}::DOUBLE * n
  ORDER BY cf DESC, term LIMIT {cap})"""


def _weights_sql(source: str = "terms", carry: str = "") -> str:
    c = f", {carry}" if carry else ""
    return f"""
tf AS (SELECT doc_id{c}, term, count(*) AS tf FROM {source} GROUP BY ALL),
raw AS (SELECT t.*, (ln(tf::DOUBLE) + 1.0::DOUBLE) * idf AS w
        FROM tf t JOIN vocabulary v ON t.term = v.term),
weights AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


_SMALL = vb.TermSettings(max_features=2_000)


@query(f"""WITH {DOCUMENTS_SQL}, {terms_sql('docs', 'doc_id', 'cleaned_text')},
{_vocabulary_sql(5, 0.95, 2_000)} SELECT term, df, cf, round(idf, 9) AS idf FROM vocabulary""")
def vocabulary_capped(spark, sf):
    df = vb.fit_vocabulary(documents(spark, sf), settings=_SMALL)
    return reports.rounded(df, ["idf"], 9)


@query(f"""WITH {DOCUMENTS_SQL}, {terms_sql('docs', 'doc_id', 'cleaned_text')},
{_vocabulary_sql(5, 0.95, 2_000)}, {_weights_sql()}
SELECT doc_id, term, round(weight, 9) AS weight FROM weights""")
def tfidf_weights(spark, sf):
    df = vb.tfidf(documents(spark, sf), "doc_id", settings=_SMALL)
    return df.select("doc_id", "term", F.round("weight", 9).alias("weight"))


@query(f"""WITH {DOCUMENTS_SQL}, parts AS (SELECT *, {split_sql('source')} AS split FROM docs),
train AS (SELECT * FROM parts WHERE split = 'train'),
{terms_sql('parts', 'doc_id', 'cleaned_text', 'split').replace('terms AS', 'all_terms AS').replace('words', 'all_words')},
terms AS (SELECT * FROM all_terms WHERE split = 'train'),
{_vocabulary_sql(5, 0.95, 2_000, 'train')},
held AS (SELECT doc_id, term FROM all_terms WHERE split <> 'train'), {_weights_sql('held')}
SELECT doc_id, count(*) AS terms, round(sum(weight), 9) AS total, round(max(weight), 9) AS largest
FROM weights GROUP BY 1""")
def tfidf_of_other_splits(spark, sf):
    """Fitted on train, applied to val and test."""
    parts = splits.by_group(documents(spark, sf), "source")
    fitted = vb.fit_vocabulary(parts.filter("split = 'train'"), settings=_SMALL)
    df = vb.tfidf_weights(parts.filter("split <> 'train'"), fitted, "doc_id", settings=_SMALL)
    return df.groupBy("doc_id").agg(
        F.count("*").alias("terms"), F.round(F.sum("weight"), 9).alias("total"),
        F.round(F.max("weight"), 9).alias("largest"),
    )


@query(f"""WITH {DOCUMENTS_SQL}, parts AS (SELECT *, {split_sql('source')} AS split FROM docs),
train AS (SELECT * FROM parts WHERE split = 'train'),
{terms_sql('train', 'doc_id', 'cleaned_text')}, {_vocabulary_sql(5, 0.95, 2_000, 'train')}
SELECT split, count(*) AS rows, (SELECT count(*) FROM vocabulary) AS features FROM parts GROUP BY 1""")
def feature_summary(spark, sf):
    parts = splits.by_group(documents(spark, sf), "source")
    fitted = vb.fit_vocabulary(parts.filter("split = 'train'"), settings=_SMALL)
    return vb.feature_summary(fitted, parts)


# ---------------------------------------------------------------- neighbours in term space
_SPARSE = vb.TermSettings(max_features=500)
_SPARSE_SQL = f"""{DOCUMENTS_SQL}, {terms_sql('docs', 'doc_id', 'cleaned_text')}, {_vocabulary_sql(5, 0.95, 500)}, {_weights_sql()},
ids AS (SELECT DISTINCT doc_id, {split_sql('doc_id')} AS split FROM weights),
dots AS (SELECT a.doc_id AS q, b.doc_id AS c, sum(a.weight * b.weight) AS s FROM weights a JOIN weights b ON a.term = b.term GROUP BY 1, 2)"""


def _term_rows(spark, sf):
    """Every document with a known term as one sparse row, with its split, language and source."""
    docs = documents(spark, sf)
    vocabulary = vb.with_term_ids(vb.fit_vocabulary(docs, settings=_SPARSE))
    rows = vb.sparse_documents(docs, vocabulary, "doc_id", settings=_SPARSE, carry=["lang", "source"])
    return splits.by_group(cut_lineage(rows.select("doc_id", "lang", "source", "indices", "weights")), "doc_id")


@query(f"""WITH {_SPARSE_SQL},
nearest AS (SELECT a.doc_id AS query_id, b.doc_id AS neighbor_id, round(coalesce(s, 0), 9) AS score,
  row_number() OVER (PARTITION BY a.doc_id ORDER BY round(coalesce(s, 0), 9) DESC, b.doc_id) AS neighbor_rank
  FROM ids a JOIN ids b ON a.doc_id <> b.doc_id LEFT JOIN dots ON q = a.doc_id AND c = b.doc_id QUALIFY neighbor_rank <= 5)
SELECT query_id, neighbor_rank, neighbor_id, score FROM nearest""")
def nearest_sparse_partitioned(spark, sf):
    """The five documents nearest to each in TF-IDF, by blocks: the form for any number of queries."""
    rows = _term_rows(spark, sf)
    return neighbours.nearest_sparse(rows, rows, 5, "doc_id", "doc_id", broadcast_queries=0, block_rows=250)


@query(f"""WITH {_SPARSE_SQL},
nearest AS (SELECT a.doc_id AS query_id, b.doc_id AS neighbor_id,
  row_number() OVER (PARTITION BY a.doc_id ORDER BY round(coalesce(s, 0), 9) DESC, b.doc_id) AS neighbor_rank
  FROM ids a JOIN ids b ON a.split = 'val' AND b.split = 'train' LEFT JOIN dots ON q = a.doc_id AND c = b.doc_id QUALIFY neighbor_rank <= 10),
firsts AS (SELECT query_id, min(neighbor_rank) FILTER (x.lang IS NOT DISTINCT FROM y.lang AND x.source IS NOT DISTINCT FROM y.source) AS r
  FROM nearest JOIN docs x ON x.doc_id = query_id JOIN docs y ON y.doc_id = neighbor_id GROUP BY 1)
SELECT round(avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 END), 9) AS recall_at_10,
       round(avg(coalesce(1.0::DOUBLE / r, 0)), 9) AS mrr_at_10, count(*) AS queries FROM firsts""")
def sparse_retrieval_scores(spark, sf):
    """TF-IDF retrieval of the whole val split, with more queries than may be broadcast."""
    rows = _term_rows(spark, sf)
    asked = rows.filter("split = 'val'")
    db = rows.filter("split = 'train'").withColumnsRenamed({"lang": "db_lang", "source": "db_source"})
    found = neighbours.nearest_sparse(
        asked, db, 10, "doc_id", "doc_id", ["db_lang", "db_source"], exclude_self=False, broadcast_queries=10, block_rows=100)
    own = asked.select(F.col("doc_id").alias("query_id"), "lang", "source")
    flagged = found.join(own, "query_id").withColumn(
        "relevant", F.col("lang").eqNullSafe(F.col("db_lang")) & F.col("source").eqNullSafe(F.col("db_source")))
    return reports.rounded(evaluation.retrieval_scores(flagged, 10), ["recall_at_10", "mrr_at_10"], 9)


# ---------------------------------------------------------------- keywords
def _lift_sql(cluster: str, top: int = 8) -> str:
    return f"""
sums AS (SELECT {cluster}, term, sum(weight) AS s FROM weights GROUP BY 1, 2),
sizes AS (SELECT {cluster}, count(*) AS n FROM docs GROUP BY 1),
grid AS (SELECT z.{cluster}, z.n, g.term, g.total
         FROM sizes z, (SELECT term, sum(s) AS total FROM sums GROUP BY 1) g),
lifts AS (SELECT grid.{cluster}, grid.term,
                 round(coalesce(s, 0) / grid.n - total / (SELECT count(*) FROM docs), 9) AS lift
          FROM grid LEFT JOIN sums
          ON grid.{cluster} = sums.{cluster} AND grid.term = sums.term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {cluster} ORDER BY lift DESC, term) AS term_rank
           FROM lifts QUALIFY term_rank <= {top})"""


_KEYWORD = vb.TermSettings(**vb.KEYWORD_SETTINGS, stop_words=STOP_WORDS)
_KEYWORD_CTE = f"""{DOCUMENTS_SQL}, {terms_sql('docs', 'doc_id', 'cleaned_text', 'lang', stop=True)},
{_vocabulary_sql(15, 0.70, 30_000)}, {_weights_sql(carry='lang')}, {_lift_sql('lang')}"""


@query(f"WITH {_KEYWORD_CTE} SELECT lang, term, lift, term_rank FROM ranked")
def keywords_per_category(spark, sf):
    return vb.cluster_terms(documents(spark, sf), "doc_id", "lang", settings=_KEYWORD)


@query(f"""WITH {REVIEWS_SQL}, {DOCUMENTS_SQL.replace('AS (SELECT doc_id, lang, source,',
       'AS (SELECT doc_id, lang,').replace('FROM documents', 'FROM documents')},
{terms_sql('docs', 'doc_id', 'cleaned_text', 'lang', stop=True)},
{_vocabulary_sql(15, 0.70, 30_000)}, {_weights_sql(carry='lang')}, {_lift_sql('lang')},
named AS (SELECT lang, string_agg(term, ', ' ORDER BY term_rank) AS top_terms FROM ranked GROUP BY 1),
own AS (SELECT main_category AS lang, parent_asin, {sentiment_sql('rating')} AS sentiment FROM reviews),
a AS (SELECT lang, parent_asin AS v, count(*) AS n FROM own GROUP BY 1, 2),
b AS (SELECT lang, sentiment AS v, count(*) AS n FROM own GROUP BY 1, 2),
ma AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS t FROM a
       QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, v) = 1),
mb AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS t FROM b
       QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, v) = 1)
SELECT ma.lang AS cluster, ma.t::BIGINT AS size, ma.v AS dominant_category,
       ma.n::DOUBLE / ma.t AS dominant_category_share, mb.v AS dominant_sentiment,
       mb.n::DOUBLE / mb.t AS dominant_sentiment_share, top_terms
FROM ma JOIN mb ON ma.lang = mb.lang JOIN named ON ma.lang = named.lang""")
def cluster_summary(spark, sf):
    """Clusters given: the language of a document; category: its source."""
    df = reviews(spark, sf).select(
        "row_id", F.col("main_category").alias("cluster"), F.col("parent_asin").alias("main_category"),
        labels.sentiment("rating").alias("sentiment"), tx.clean_text("text").alias("cleaned_text"),
    )
    return latent_space.cluster_summary(df, "row_id", settings=_KEYWORD)


# ---------------------------------------------------------------- errors over text
@query(f"""WITH {REVIEWS_SQL}, e AS (
  SELECT row_id, {clean_sql('text')} AS cleaned_text, main_category AS true_label,
         CASE WHEN length(text) % 3 = 0 THEN 'en' WHEN length(text) % 3 = 1 THEN 'fr' ELSE 'de' END
           AS predicted_label FROM reviews)
SELECT * FROM (SELECT * FROM e WHERE true_label <> predicted_label
               ORDER BY md5(concat_ws('||', '42', row_id::VARCHAR)), row_id LIMIT 50)""")
def misclassified_examples(spark, sf):
    third = F.char_length("text") % 3
    df = reviews(spark, sf).select(
        "row_id", tx.clean_text("text").alias("cleaned_text"), F.col("main_category").alias("y_true"),
        F.when(third == 0, "en").when(third == 1, "fr").otherwise("de").alias("y_pred"),
    )
    return evaluation.misclassified_examples(df, "row_id")
