"""Queries over scans, sinks, shaping, sampling, splits and audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions import casts, hashing, labels
from lexiloom.functions import text as tx
from lexiloom.operators import reports, rows, sampling, shaping, splits
from lexiloom.operators.lookups import small_side
from lexiloom.plans.registry import query
from lexiloom.plans.tables import (
    DOCUMENTS_SQL, REVIEWS_SQL, clean_sql, documents, hash_sql, reviews, sentiment_sql, split_sql,
    table, unit_sql, vectors,
)
from lexiloom.session import shared_dir
from lexiloom.sources import readers, writers

_REVIEW = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("main_category", T.StringType()), T.StructField("parent_asin", T.StringType()),
    T.StructField("rating", T.DoubleType()),
])


# ---------------------------------------------------------------- scans and sinks
@query(f"WITH {REVIEWS_SQL} SELECT row_id, main_category, parent_asin, rating, "
       "length(text)::BIGINT AS chars, md5(text) AS digest FROM reviews")
def jsonl_scan(spark, sf):
    path = writers.write_jsonl(reviews(spark, sf), shared_dir(spark, "jsonl"))
    back = readers.read_jsonl(spark, path, _REVIEW)
    return back.select(
        "row_id", "main_category", "parent_asin", "rating",
        F.char_length("text").cast("long").alias("chars"), F.md5("text").alias("digest"),
    )


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def jsonl_lenient_scan(spark, sf):
    """Document lines between raw page lines, gzip-compressed; only the former are JSON."""
    docs = table(spark, sf, "documents").select(F.to_json(F.struct("doc_id", "text")).alias("value"))
    noise = table(spark, sf, "pages").select(F.regexp_replace("html", r"[\r\n]", " ").alias("value"))
    path = shared_dir(spark, "lines")
    docs.union(noise).write.option("compression", "gzip").text(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    parts = spark.sparkContext.defaultParallelism
    return readers.read_jsonl_lenient(spark, path, schema, parts).select(
        "doc_id", F.md5("text").alias("digest")
    )


@query("SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def table_scan(spark, sf):
    return readers.read_table(spark, f"{sf}/part.parquet").select(
        "p_partkey", "p_brand", "p_size", "p_retailprice"
    )


@query("SELECT doc_id, length(coalesce(text, ''))::BIGINT AS chars FROM documents")
def text_with_fallback(spark, sf):
    df = readers.text_or_empty(table(spark, sf, "documents"), "cleaned_text", "used")
    return df.select("doc_id", F.char_length("used").cast("long").alias("chars"))


@query("SELECT doc_id, 'text' AS used_column FROM documents WHERE text IS NOT NULL")
def split_load(spark, sf):
    df, used = readers.load_split(table(spark, sf, "documents"), "body")
    return df.select("doc_id", F.lit(used).alias("used_column"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def csv_report_roundtrip(spark, sf):
    made = table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")
    )
    path = writers.write_report_csv(made, shared_dir(spark, "csv"))
    return readers.read_csv(spark, path, made.schema)


@query(f"WITH s AS (SELECT {split_sql('source')} AS split FROM documents) "
       "SELECT count(*) FILTER (split = 'train') AS train_rows, "
       "count(*) FILTER (split = 'val') AS val_rows, "
       "count(*) FILTER (split = 'test') AS test_rows FROM s")
def json_summary_roundtrip(spark, sf):
    from lexiloom.plans.jobs import split_summary

    made = split_summary(splits.by_group(table(spark, sf, "documents"), "source"))
    path = writers.write_summary_json(made, shared_dir(spark, "json"))
    return readers.read_json_document(spark, path, made.schema)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def read_through_table(spark, sf):
    path = shared_dir(spark, "stored")

    def compute():
        return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))

    readers.read_through(spark, path, compute)
    return readers.read_through(spark, path, lambda: compute().limit(0))


@query(f"SELECT {split_sql('source')} AS split, count(*) AS n, "
       "count(DISTINCT source) AS products FROM documents GROUP BY 1")
def partitioned_table_sink(spark, sf):
    path = writers.write_table(
        splits.by_group(table(spark, sf, "documents"), "source"), shared_dir(spark, "splits"), "split"
    )
    return readers.read_table(spark, path).groupBy("split").agg(
        F.count("*").alias("n"), F.count_distinct("source").alias("products")
    )


@query("SELECT count(*) AS n, true AS within_limit FROM lineitem")
def chunked_sink(spark, sf):
    path = writers.write_chunks(table(spark, sf, "lineitem"), shared_dir(spark, "chunks"), 20_000)
    files = readers.read_table(spark, path).groupBy(F.input_file_name().alias("f")).count()
    return files.agg(
        F.sum("count").alias("n"), (F.max("count") <= 20_000).alias("within_limit")
    )


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def vector_sink(spark, sf):
    path = writers.write_vectors(vectors(spark, sf), shared_dir(spark, "vectors"))
    written = readers.read_table(spark, path).select("row_id", F.size("vector").alias("dims"))
    full = written.filter("dims > 0").join(vectors(spark, sf).select("row_id", "label"), "row_id")
    return full.groupBy("label").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- shaping
@query("SELECT o_orderkey, o_totalprice FROM orders")
def keep_available_columns(spark, sf):
    return shaping.keep_available(
        table(spark, sf, "orders"), ["o_orderkey", "not_there", "o_totalprice"]
    )


@query("SELECT doc_id, source AS main_category FROM documents")
def category_from_file_name(spark, sf):
    df = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("/data/raw/"), "source", F.lit(".jsonl.gz")).alias("path")
    )
    return shaping.with_category(df, tx.category_from_path("path")).drop("path")


@query("SELECT page_id, 'pages' AS main_category FROM pages")
def constant_category(spark, sf):
    return shaping.with_category(table(spark, sf, "pages").select("page_id"), "pages")


@query("SELECT doc_id, lang AS main_category FROM documents")
def renamed_category(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("category"))
    return shaping.rename_category(df)


@query(f"WITH {REVIEWS_SQL} SELECT row_id, rating, {sentiment_sql('rating')} AS sentiment FROM reviews")
def sentiment_of_ratings(spark, sf):
    return shaping.with_sentiment(reviews(spark, sf)).select("row_id", "rating", "sentiment")


@query(f"SELECT {sentiment_sql('l_linenumber')} AS sentiment, count(*) AS n FROM lineitem GROUP BY 1")
def sentiment_at_volume(spark, sf):
    df = table(spark, sf, "lineitem").select(labels.sentiment("l_linenumber").alias("sentiment"))
    return df.groupBy("sentiment").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {hash_sql('doc_id')}, doc_id) - 1 AS row_id "
       "FROM documents")
def dense_row_ids(spark, sf):
    return rows.with_row_id(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query(f"WITH c AS (SELECT {clean_sql('html')} AS t FROM pages UNION ALL "
       f"SELECT {clean_sql('regexp_replace(text, $$[A-Za-z0-9]$$, $$$$, $$g$$)')} FROM conversations) "
       "SELECT count(*) AS rows, count(*) FILTER (length(t) = 0) AS dropped, "
       "count(*) FILTER (length(t) = 0) * 100.0::DOUBLE / count(*) AS dropped_percent FROM c")
def empty_text_drop(spark, sf):
    pages = table(spark, sf, "pages").select(tx.clean_text("html").alias("cleaned_text"))
    bare = table(spark, sf, "conversations").select(
        tx.clean_text(F.regexp_replace("text", "[A-Za-z0-9]", "")).alias("cleaned_text")
    )
    return shaping.empty_text_report(shaping.union_tables(pages, bare))


@query(f"SELECT conv_id, turn, {clean_sql('text')} AS cleaned_text FROM conversations "
       f"WHERE length({clean_sql('text')}) > 0")
def nonempty_text(spark, sf):
    df = shaping.with_cleaned_text(table(spark, sf, "conversations"))
    return shaping.drop_empty_text(df).select("conv_id", "turn", "cleaned_text")


@query(f"WITH {REVIEWS_SQL} SELECT row_id, rating FROM reviews WHERE rating IS NOT NULL "
       "AND text IS NOT NULL")
def rows_without_missing(spark, sf):
    return shaping.drop_missing(reviews(spark, sf), ["rating", "text"]).select("row_id", "rating")


_SPELLED = {"en": "Home & Kitchen", "fr": "sports_and_outdoors", "de": "ELECTRONICS!", "es": "Books"}


def _spelled():
    pairs = list(_SPELLED.items())
    out = F.when(F.col("lang") == pairs[0][0], pairs[0][1])
    for k, v in pairs[1:]:
        out = out.when(F.col("lang") == k, v)
    return out


_SPELLED_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SPELLED.items()) + " END"
_CANON_SQL = (
    f"CASE regexp_replace(lower({_SPELLED_SQL}), '[^\\p{{L}}\\p{{N}}]', '', 'g') "
    "WHEN 'homekitchen' THEN 'Home_and_Kitchen' WHEN 'sportsandoutdoors' THEN 'Sports_and_Outdoors' "
    f"WHEN 'electronics' THEN 'Electronics' ELSE {_SPELLED_SQL} END"
)


@query(f"SELECT doc_id, {_CANON_SQL} AS main_category FROM documents")
def canonical_categories(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", labels.canonical_category(_spelled()).alias("main_category")
    )


@query(f"SELECT doc_id, {_CANON_SQL} AS main_category FROM documents WHERE lang <> 'es'")
def category_scope(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", _spelled().alias("main_category"))
    allowed = ["Electronics", "home kitchen", "Sports", "Beauty"]
    return shaping.category_scope(df, allowed, strict=False)


@query(f"SELECT DISTINCT {_CANON_SQL} AS main_category FROM documents WHERE lang = 'es'")
def unexpected_categories(spark, sf):
    df = table(spark, sf, "documents").select(_spelled().alias("main_category"))
    return shaping.unexpected_categories(df, ["Electronics", "home kitchen", "Sports", "Beauty"])


def _raw_events(spark, sf):
    """Untyped records: numbers as text (some unreadable), missing titles and flags."""
    flag = F.when(F.col("event_type") == "click", "true").when(F.col("event_type") == "view", "false")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(
            F.get_json_object("props", "$.k")).alias("rating"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("title"),
        F.when(F.col("event_type") != "error", F.col("props")).alias("text"),
        F.col("event_type").alias("category"),
        (F.col("user_id") % 50).cast("string").alias("parent_asin"),
        F.col("user_id").cast("string").alias("user_id"),
        (F.col("event_id") * 977 + F.lit(1704067200000)).cast("string").alias("timestamp"),
        F.col("value").cast("string").alias("helpful_vote"),
        flag.alias("verified_purchase"),
    )


_RAW_EVENTS_SQL = """
raw AS (
  SELECT event_id AS row_id,
         CASE WHEN event_type = 'error' THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS rating,
         CASE WHEN event_type <> 'view' THEN event_type END AS title,
         CASE WHEN event_type <> 'error' THEN props END AS text,
         event_type AS category, (user_id % 50)::VARCHAR AS parent_asin,
         user_id::VARCHAR AS user_id, (event_id * 977 + 1704067200000)::VARCHAR AS timestamp,
         value AS helpful_vote,
         CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false END AS verified_purchase
  FROM events)"""
_SHAPED_SQL = f"""{_RAW_EVENTS_SQL},
shaped AS (
  SELECT row_id, category, TRY_CAST(rating AS DOUBLE) AS rating, coalesce(title, '') AS title,
         coalesce(text, '') AS text, parent_asin, user_id, TRY_CAST(timestamp AS BIGINT) AS timestamp,
         trunc(helpful_vote)::BIGINT AS helpful_vote,
         coalesce(verified_purchase, false) AS verified_purchase,
         length(coalesce(text, ''))::BIGINT AS text_len
  FROM raw)"""


@query(f"WITH {_SHAPED_SQL} SELECT *, "
       "strftime(epoch_ms(timestamp), '%Y-%m-%d %H:%M:%S') AS review_time FROM shaped")
def shaped_records(spark, sf):
    df = shaping.shape_review(_raw_events(spark, sf))
    return df.withColumn("text_len", F.col("text_len").cast("long")).withColumn(
        "review_time", F.date_format("review_time", "yyyy-MM-dd HH:mm:ss")
    )


@query(f"WITH {_SHAPED_SQL} SELECT row_id, text_len FROM shaped WHERE text_len > 0")
def records_with_text(spark, sf):
    df = shaping.shape_review(_raw_events(spark, sf)).filter("text_len > 0")
    return df.select("row_id", F.col("text_len").cast("long").alias("text_len"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number, "
       "TRY_CAST(event_type AS DOUBLE) AS bad_number, "
       "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS whole, "
       "coalesce(TRY_CAST(CASE event_type WHEN 'click' THEN 'true' WHEN 'view' THEN 'false' END "
       "AS BOOLEAN), false) AS flag, user_id::VARCHAR AS label, "
       "coalesce(TRY_CAST(event_type AS DOUBLE), value) AS first_set FROM events")
def tolerant_casts(spark, sf):
    k = F.get_json_object("props", "$.k")
    flag = F.when(F.col("event_type") == "click", "true").when(F.col("event_type") == "view", "false")
    return table(spark, sf, "events").select(
        "event_id", casts.to_number(k).alias("number"),
        casts.to_number("event_type").alias("bad_number"), casts.to_whole(k).alias("whole"),
        casts.to_flag(flag).alias("flag"), F.col("user_id").cast("string").alias("label"),
        casts.first_non_null(casts.to_number("event_type"), "value").alias("first_set"),
    )


@query("SELECT l_orderkey AS key, 'lineitem' AS origin, l_quantity AS amount FROM lineitem "
       "UNION ALL SELECT o_orderkey, 'orders', NULL FROM orders")
def union_of_tables(spark, sf):
    a = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.lit("lineitem").alias("origin"),
        F.col("l_quantity").alias("amount"),
    )
    b = table(spark, sf, "orders").select(
        F.lit("orders").alias("origin"), F.col("o_orderkey").alias("key")
    )
    return shaping.union_tables(a, b)


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def membership_select(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(
        table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi"
    )


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def rows_not_drawn(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(
        table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti"
    )


@query("SELECT (SELECT count(*) FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id) AS matched, "
       "(SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) "
       "AS without_vector, "
       "(SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) "
       "AS without_label")
def vector_label_alignment(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    return rows.alignment_report(vectors(spark, sf), docs)


@query("SELECT e.vec_id AS row_id, e.label, d.lang FROM embeddings e JOIN documents d "
       "ON e.vec_id = d.doc_id")
def aligned_vectors(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    return rows.align(vectors(spark, sf).select("row_id", "label"), docs)


# ---------------------------------------------------------------- sampling
@query(f"SELECT doc_id, lang FROM documents ORDER BY {hash_sql('doc_id')}, doc_id LIMIT 150")
def sample_exact(spark, sf):
    return sampling.exact(table(spark, sf, "documents").select("doc_id", "lang"), 150, "doc_id")


@query(f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {hash_sql('o_orderkey')}, o_orderkey "
       "LIMIT 12000")
def sample_exact_large(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sampling.exact(df, 12_000, "o_orderkey")


_EVENT_KEY_SQL = "concat_ws('||', event_id, user_id, event_type, props)"


@query(f"SELECT event_id, event_type FROM events WHERE {unit_sql(f'md5({_EVENT_KEY_SQL})')} < 0.3")
def sample_by_record_hash(spark, sf):
    df = sampling.fraction(
        table(spark, sf, "events"), 0.3, "event_id", "user_id", "event_type", "props"
    )
    return df.select("event_id", "event_type")


@query("SELECT event_type, count(*) AS total_rows, least(1.0::DOUBLE, 1250.0::DOUBLE / count(*)) "
       "AS keep_prob FROM events GROUP BY 1")
def keep_probabilities(spark, sf):
    return sampling.keep_probability(table(spark, sf, "events"), "event_type", 1000)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang "
       f"ORDER BY {hash_sql('doc_id')}, doc_id) AS n FROM documents) WHERE n <= 40")
def sample_per_category(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.exact_after_dedup(df, 40, "lang", "doc_id", strict=False)


@query(f"SELECT c_custkey FROM customer ORDER BY {hash_sql('c_custkey')}, c_custkey LIMIT 500")
def row_cap(spark, sf):
    return sampling.row_cap(table(spark, sf, "customer").select("c_custkey"), 500, "c_custkey")


@query("WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), "
       f"r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY "
       f"{hash_sql('vec_id')}, vec_id) AS n FROM embeddings) "
       "SELECT vec_id, label FROM r WHERE n <= (SELECT least(100, min(n)) FROM s)")
def sample_balanced(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", "label")
    return sampling.smallest_class_sample(df, 100, "vec_id", "label")


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source "
       f"ORDER BY {hash_sql('doc_id')}, doc_id) AS n FROM documents) WHERE n = 1")
def one_row_per_category(spark, sf):
    df = table(spark, sf, "documents").select("source", "doc_id")
    return sampling.exact_per_group(df, 1, "doc_id", ["source"])


@query(f"SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label "
       f"ORDER BY {hash_sql('vec_id')}, vec_id) AS n FROM embeddings) WHERE n <= 20")
def query_sample_per_class(spark, sf):
    from lexiloom.operators.latent_space import sampled_queries

    return sampled_queries(
        table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id", 20
    )


@query("WITH p AS (SELECT event_type, least(1.0::DOUBLE, 1250.0::DOUBLE / count(*)) AS keep_prob "
       "FROM events GROUP BY 1) SELECT e.event_type, count(*) AS seen, "
       f"count(*) FILTER ({unit_sql(f'md5({_EVENT_KEY_SQL})')} < p.keep_prob) AS kept, "
       "max(p.keep_prob) AS keep_prob FROM events e JOIN p ON e.event_type = p.event_type "
       "GROUP BY 1".replace("event_id, user_id, event_type", "event_id, user_id, e.event_type"))
def sampling_log(spark, sf):
    df = table(spark, sf, "events")
    probs = sampling.keep_probability(df, "event_type", 1000).select("event_type", "keep_prob")
    key = hashing.record_key("event_id", "user_id", "event_type", "props")
    marked = df.join(small_side(probs), "event_type").withColumn(
        "kept", hashing.keep_with_probability(key, F.col("keep_prob"))
    )
    return sampling.sampling_log(marked, "event_type", "kept", "keep_prob")


# ---------------------------------------------------------------- splits
@query(f"SELECT l_partkey, {split_sql('l_partkey')} AS split, count(*) AS n FROM lineitem GROUP BY 1, 2")
def split_by_group(spark, sf):
    df = splits.by_group(table(spark, sf, "lineitem").select("l_partkey"), "l_partkey")
    return df.groupBy("l_partkey", "split").agg(F.count("*").alias("n"))


_EXACT_SPLIT_SQL = f"""
g AS (SELECT l_partkey, row_number() OVER (ORDER BY {hash_sql('l_partkey')}, l_partkey) AS r,
             count(*) OVER () AS n FROM (SELECT DISTINCT l_partkey FROM lineitem)),
t AS (SELECT *, ceil(0.15::DOUBLE * n) AS nt FROM g),
v AS (SELECT *, ceil((0.15::DOUBLE / (1.0::DOUBLE - 0.15::DOUBLE)) * (n - nt)) AS nv FROM t),
s AS (SELECT l_partkey, CASE WHEN r <= nt THEN 'test' WHEN r <= nt + nv THEN 'val' ELSE 'train' END
      AS split FROM v)"""


@query(f"WITH {_EXACT_SPLIT_SQL} SELECT split, count(DISTINCT l.l_partkey) AS groups, count(*) AS n "
       "FROM lineitem l JOIN s ON l.l_partkey = s.l_partkey GROUP BY 1")
def split_exact_groups(spark, sf):
    df = splits.by_group_exact(table(spark, sf, "lineitem").select("l_partkey"), "l_partkey")
    return df.groupBy("split").agg(
        F.count_distinct("l_partkey").alias("groups"), F.count("*").alias("n")
    )


@query(f"SELECT o_orderkey, {split_sql('o_orderkey', 0.2, 0.1)} AS split FROM orders")
def split_rows(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey")
    return splits.by_group(df, "parent_asin", test=0.2, val=0.1, row_key="o_orderkey")


@query(f"WITH s AS (SELECT l_suppkey, {split_sql('l_partkey')} AS split FROM lineitem) "
       "SELECT l_suppkey, count(DISTINCT split) AS splits, count(*) AS rows FROM s GROUP BY 1 "
       "HAVING count(DISTINCT split) > 1")
def leaked_groups(spark, sf):
    """Split by part, checked by supplier: suppliers do leak."""
    df = splits.by_group(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey")
    return splits.leaked_groups(df, "l_suppkey")


@query(f"WITH s AS (SELECT l_suppkey, {split_sql('l_partkey')} AS split FROM lineitem) "
       "SELECT l_suppkey FROM s WHERE split = 'train' INTERSECT "
       "SELECT l_suppkey FROM s WHERE split = 'test'")
def shared_groups(spark, sf):
    df = splits.by_group(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey")
    return splits.shared_groups(df, "train", "test", "l_suppkey")


@query(f"SELECT count(*) AS leaked FROM (SELECT l_partkey FROM (SELECT l_partkey, "
       f"{split_sql('l_partkey')} AS split FROM lineitem) GROUP BY 1 HAVING count(DISTINCT split) > 1)")
def leakage_check(spark, sf):
    df = splits.by_group(table(spark, sf, "lineitem").select("l_partkey"), "l_partkey")
    return splits.leaked_groups(df, "l_partkey").agg(F.count("*").alias("leaked"))


# ---------------------------------------------------------------- audits
@query("SELECT l_returnflag, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1")
def value_counts(spark, sf):
    return reports.value_counts(table(spark, sf, "lineitem"), "l_returnflag")


@query(f"WITH {REVIEWS_SQL} SELECT rating, count(*) AS count FROM reviews GROUP BY 1 ORDER BY 1 NULLS FIRST")
def value_counts_with_missing(spark, sf):
    return reports.value_counts_all(reviews(spark, sf), "rating")


@query(f"WITH {REVIEWS_SQL}, s AS (SELECT {sentiment_sql('rating')} AS sentiment FROM reviews) "
       "SELECT sentiment, count(*)::DOUBLE / (SELECT count(*) FROM s) AS share FROM s GROUP BY 1")
def value_shares(spark, sf):
    return reports.value_shares(shaping.with_sentiment(reviews(spark, sf)), "sentiment")


def _describe_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, "
        f"round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, "
        f"quantile_cont({c}, 0.25)::DOUBLE AS p25, quantile_cont({c}, 0.5)::DOUBLE AS p50, "
        f"quantile_cont({c}, 0.75)::DOUBLE AS p75, max({c})::DOUBLE AS max FROM lineitem"
    )


@query(" UNION ALL ".join(_describe_sql(c) for c in ("l_quantity", "l_linenumber", "l_tax")))
def numeric_description(spark, sf):
    df = reports.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_linenumber", "l_tax"])
    return reports.rounded(df, ["mean", "std"], 6)


@query(f"WITH {REVIEWS_SQL} SELECT 'text' AS \"column\", count(*) FILTER (text IS NULL) AS missing "
       "FROM reviews UNION ALL SELECT 'rating', count(*) FILTER (rating IS NULL) FROM reviews")
def missing_values(spark, sf):
    return reports.missing_values(reviews(spark, sf), ["text", "rating"])


@query("SELECT count(DISTINCT source) AS distinct_source, count(DISTINCT lang) AS distinct_lang FROM documents")
def distinct_keys(spark, sf):
    return reports.distinct_keys(table(spark, sf, "documents"), "source", "lang")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, text "
       "ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def first_of_duplicates(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return reports.drop_duplicates(df, ["lang", "text"], ["doc_id"]).select("doc_id", "lang")


@query("""WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS k,
             sum(n) OVER (PARTITION BY l_suppkey) AS total FROM c)
SELECT l_suppkey, total::BIGINT AS size, l_returnflag AS flag, n::DOUBLE / total AS flag_share
FROM r WHERE k = 1""")
def dominant_value(spark, sf):
    return reports.group_mode(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", "flag")


@query("""WITH c AS (SELECT l_linenumber, l_returnflag, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY l_linenumber) AS share FROM c)
SELECT l_linenumber, coalesce(max(share) FILTER (l_returnflag = 'A'), 0) AS "A",
       coalesce(max(share) FILTER (l_returnflag = 'N'), 0) AS "N",
       coalesce(max(share) FILTER (l_returnflag = 'R'), 0) AS "R" FROM s GROUP BY 1""")
def crosstab_shares(spark, sf):
    return reports.crosstab_shares(
        table(spark, sf, "lineitem"), "l_linenumber", "l_returnflag", ["A", "N", "R"]
    )


_GROUP_STATS_SQL = (
    "SELECT event_type, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std, "
    "round(stddev_pop(value), 9) AS std_pop, count(value) AS count FROM events GROUP BY 1"
)


@query(_GROUP_STATS_SQL)
def group_statistics(spark, sf):
    df = reports.group_stats(table(spark, sf, "events"), "event_type", "value")
    return reports.rounded(df, ["mean", "std", "std_pop"], 9)


@query(f"WITH s AS ({_GROUP_STATS_SQL}) SELECT "
       "(SELECT event_type FROM s ORDER BY mean DESC, event_type LIMIT 1) AS best, "
       "(SELECT max(mean) FROM s) AS best_value, "
       "(SELECT event_type FROM s ORDER BY mean, event_type LIMIT 1) AS worst, "
       "(SELECT min(mean) FROM s) AS worst_value")
def best_and_worst_group(spark, sf):
    df = reports.group_stats(table(spark, sf, "events"), "event_type", "value")
    return reports.extremes(reports.rounded(df, ["mean"], 9), "event_type", "mean")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def lowest_scores(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return reports.lowest(df, "o_totalprice", "o_orderkey", 20)


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 1000")
def first_rows_as_queries(spark, sf):
    return table(spark, sf, "documents").select("doc_id").orderBy("doc_id").limit(1000)
