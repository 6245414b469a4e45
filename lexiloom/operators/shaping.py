"""Projections, filters, set operations and record shaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import casts, labels
from lexiloom.functions import text as tx
from lexiloom.functions import vectors as vec
from lexiloom.schema import require_column


def keep_available(df: DataFrame, columns) -> DataFrame:
    """The listed columns that exist, in list order."""
    return df.select([c for c in columns if c in df.columns])


def with_category(df: DataFrame, category: Column | str, name: str = "main_category") -> DataFrame:
    """Add a category: a constant (str) or an expression, e.g. taken from the file name."""
    value = F.lit(category) if isinstance(category, str) else category
    return df.withColumn(name, value)


def rename_category(df: DataFrame) -> DataFrame:
    """``category`` becomes ``main_category`` unless that exists already."""
    if "category" in df.columns and "main_category" not in df.columns:
        return df.withColumnRenamed("category", "main_category")
    return df


def with_sentiment(df: DataFrame) -> DataFrame:
    """Add the sentiment band of ``rating`` unless a sentiment column exists."""
    if "sentiment" in df.columns:
        return df
    if "rating" not in df.columns:
        raise ValueError("neither a 'sentiment' nor a 'rating' column exists")
    return df.withColumn("sentiment", labels.sentiment("rating"))


def with_cleaned_text(df: DataFrame, source: str = "text") -> DataFrame:
    """Add ``cleaned_text`` unless it exists; an error if there is no text to clean."""
    if "cleaned_text" in df.columns:
        return df
    if source not in df.columns:
        raise ValueError(f"no column '{source}' to clean; there are {', '.join(df.columns)}")
    return df.withColumn("cleaned_text", tx.clean_text(source))


def drop_empty_text(df: DataFrame, column: str = "cleaned_text") -> DataFrame:
    return df.filter(F.length(column) > 0)


def empty_text_report(df: DataFrame, column: str = "cleaned_text") -> DataFrame:
    """rows, dropped and dropped_percent of ``drop_empty_text`` in one pass."""
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(~(F.coalesce(F.length(column), F.lit(0)) > 0)).alias("dropped"),
    ).withColumn("dropped_percent", F.try_divide(F.col("dropped") * 100.0, F.col("rows")))


def drop_missing(df: DataFrame, columns) -> DataFrame:
    return df.dropna(subset=list(columns))


def drop_zero_vectors(df: DataFrame, vector: str = "vector") -> DataFrame:
    return df.filter(vec.is_nonzero(vector))


def tokenized(
    df: DataFrame, column: str, min_tokens: int = 1, max_tokens: int = 0, name: str = "tokens"
) -> DataFrame:
    """Add token lists and drop the rows whose list is empty."""
    return df.withColumn(name, tx.tokenize(column, min_tokens, max_tokens)).filter(
        F.size(name) > 0
    )


def unexpected_categories(df: DataFrame, allowed, column: str = "main_category") -> DataFrame:
    """Canonical category values outside the allowed set."""
    found = df.select(labels.canonical_category(column).alias(column)).distinct()
    return found.filter(~F.col(column).isin(labels.canonical_names(allowed)))


def category_scope(
    df: DataFrame,
    allowed,
    column: str = "main_category",
    strict: bool = True,
    what: str = "input",
    shown: int = 20,
) -> DataFrame:
    """Canonicalise categories; unknown ones are an error (strict) or are dropped.

    Strict mode runs one distinct aggregation and brings at most ``shown`` names
    back for the message.
    """
    require_column(df, column, "category")
    if strict:
        unknown = unexpected_categories(df, allowed, column).orderBy(column).limit(shown)
        names = [str(r[0]) for r in unknown.collect()]
        if names:
            raise ValueError(
                f"unexpected categories in {what}: {', '.join(names)} "
                f"(allowed: {', '.join(sorted(labels.canonical_names(allowed)))})"
            )
    return df.withColumn(column, labels.canonical_category(column)).filter(
        F.col(column).isin(labels.canonical_names(allowed))
    )


def shape_review(df: DataFrame, category: Column | str | None = None) -> DataFrame:
    """One projection from a raw record to a typed review row.

    Text defaults to '', numbers that cannot be read become null, a missing
    purchase flag is false; adds text length and review time.
    """
    has = set(df.columns)

    def raw(name: str) -> Column:
        return F.col(name) if name in has else F.lit(None).cast("string")

    out = df.select(
        *[c for c in df.columns if c in ("row_id", "category")],
        casts.to_number(raw("rating")).alias("rating"),
        casts.to_text(raw("title")).alias("title"),
        casts.to_text(raw("text")).alias("text"),
        raw("parent_asin").cast("string").alias("parent_asin"),
        raw("user_id").cast("string").alias("user_id"),
        casts.to_whole(raw("timestamp")).alias("timestamp"),
        casts.to_whole(raw("helpful_vote")).alias("helpful_vote"),
        casts.to_flag(raw("verified_purchase")).alias("verified_purchase"),
        F.char_length(casts.to_text(raw("text"))).alias("text_len"),
        casts.epoch_ms_to_time(raw("timestamp")).alias("review_time"),
    )
    return out if category is None else with_category(out, category, "category")


def union_tables(*tables: DataFrame) -> DataFrame:
    """Union by name; columns missing on one side are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
