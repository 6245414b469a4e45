"""The given tables in the roles of the review data, in Spark and in SQL.

documents are the reviews (lang = category, source = product), labels give a
rating, embeddings are document vectors, lineitem feeds the volume queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import labels
from lexiloom.functions import text as tx
from lexiloom.operators import splits
from lexiloom.session import ship_package

# Fixed value: short stop-word list used by both sides of the keyword queries.
STOP_WORDS = (
    "the", "of", "and", "to", "is", "that", "it", "for", "in", "on", "with", "as", "was", "be",
    "are", "by", "this", "from", "or", "an",
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores when the files have fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """row_id, text, main_category, parent_asin, rating (missing where unlabelled)."""
    ship_package(spark)
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    rating = (
        F.when(F.col("toxic") == 1, 1.0).when(F.col("quality") == 1, 5.0)
        .when(F.col("quality") == 0, 3.0)
    )
    return docs.join(table(spark, sf, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("main_category"),
        F.col("source").alias("parent_asin"), rating.alias("rating"),
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, lang, source and cleaned text."""
    ship_package(spark)
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    return docs.withColumn("cleaned_text", tx.clean_text("text"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """row_id, vector, label."""
    ship_package(spark)
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), "label"
    )


def labelled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with the category, sentiment and cleaned text of the document of the same id."""
    text = reviews(spark, sf).select(
        "row_id", "main_category", labels.sentiment("rating").alias("sentiment"),
        tx.clean_text("text").alias("cleaned_text"), "parent_asin",
    )
    return vectors(spark, sf).join(text, "row_id")


REPRESENTATIONS = {
    "tfidf": ("l_quantity", 17, 34),
    "lsa": ("l_discount", 0.035, 0.075),
    "word2vec": ("l_tax", 0.025, 0.055),
}
TASKS = {
    "category": ("l_returnflag", ("A", "N", "R")),
    "sentiment": ("sentiment", ("negative", "neutral", "positive")),
}


def _band(column: str, low: float, high: float, names: tuple[str, ...]) -> Column:
    c = F.col(column)
    return F.when(c < low, names[0]).when(c < high, names[1]).otherwise(names[2])


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of every line item and banded predictions, per representation and task."""
    items = splits.by_group(
        table(spark, sf, "lineitem").withColumn("sentiment", labels.sentiment("l_linenumber")),
        "l_partkey",
    )
    rows = F.array(*[
        F.struct(
            F.lit(r).alias("representation"), F.lit(t).alias("task"),
            F.col(truth).alias("y_true"), _band(*rule, names).alias("y_pred"),
        )
        for r, rule in REPRESENTATIONS.items() for t, (truth, names) in TASKS.items()
    ])
    return items.select("l_orderkey", "l_linenumber", "split", F.inline(rows))


# ---------------------------------------------------------------- the same in SQL
def clean_sql(c: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '<[^>]+>', ' ', 'g'),"
        " '[^a-z0-9]+', ' ', 'g'))"
    )


def hash_sql(key: str, seed: str = "42") -> str:
    return f"md5(concat_ws('||', '{seed}', ({key})::VARCHAR))"


def unit_sql(digest: str) -> str:
    return f"(('0x' || substr({digest}, 1, 8))::BIGINT::DOUBLE / 4294967296.0)"


def split_sql(key: str, test: float = 0.15, val: float = 0.15) -> str:
    u = unit_sql(hash_sql(key))
    return (
        f"CASE WHEN {u} < {test} THEN 'test' WHEN {u} < {test} + {val} THEN 'val' "
        "ELSE 'train' END"
    )


def sentiment_sql(r: str) -> str:
    return (
        f"CASE WHEN {r} <= 2 THEN 'negative' WHEN {r} = 3 THEN 'neutral' ELSE 'positive' END"
    )


def terms_sql(source: str, key: str, text: str, carry: str = "", stop: bool = False) -> str:
    """CTEs ending in ``terms``: one row per term occurrence of ``source``."""
    drop = ""
    if stop:
        drop = " AND x NOT IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
    c = f", {carry}" if carry else ""
    return f"""
words AS (
  SELECT {key}{c}, list_filter(string_split({text}, ' '), lambda x: length(x) >= 2{drop}) AS w
  FROM {source}),
terms AS (
  SELECT {key}{c}, unnest(w) AS term FROM words
  UNION ALL
  SELECT {key}{c}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term
  FROM words WHERE len(w) >= 2)"""


REVIEWS_SQL = """
reviews AS (
  SELECT d.doc_id AS row_id, d.text, d.lang AS main_category, d.source AS parent_asin,
         CASE WHEN l.toxic = 1 THEN 1.0 WHEN l.quality = 1 THEN 5.0 WHEN l.quality = 0 THEN 3.0 END
           ::DOUBLE AS rating
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

DOCUMENTS_SQL = f"""
docs AS (SELECT doc_id, lang, source, {clean_sql('text')} AS cleaned_text FROM documents)"""

VECTORS_SQL = """
vectors AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS vector, label FROM embeddings)"""

LABELLED_SQL = f"""{REVIEWS_SQL}, {VECTORS_SQL},
labelled AS (
  SELECT v.row_id, v.vector, v.label, r.main_category, {sentiment_sql('r.rating')} AS sentiment,
         {clean_sql('r.text')} AS cleaned_text
  FROM vectors v JOIN reviews r ON v.row_id = r.row_id)"""


def _band_sql(column: str, low: float, high: float, names: tuple[str, ...]) -> str:
    return (
        f"CASE WHEN {column} < {low} THEN '{names[0]}' WHEN {column} < {high} THEN '{names[1]}' "
        f"ELSE '{names[2]}' END"
    )


PREDICTIONS_SQL = (
    f"items AS (SELECT *, {sentiment_sql('l_linenumber')} AS sentiment, {split_sql('l_partkey')} "
    "AS split FROM lineitem),\npredictions AS (\n"
    + "\nUNION ALL\n".join(
        f"SELECT l_orderkey, l_linenumber, split, '{r}' AS representation, '{t}' AS task, "
        f"{truth} AS y_true, {_band_sql(*rule, names)} AS y_pred FROM items"
        for r, rule in REPRESENTATIONS.items() for t, (truth, names) in TASKS.items()
    )
    + ")"
)
