"""Table schemas and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RAW_REVIEW = T.StructType(
    [
        T.StructField("rating", T.DoubleType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("parent_asin", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("helpful_vote", T.LongType()),
        T.StructField("verified_purchase", T.BooleanType()),
    ]
)

# The same record with every field as text, for sources whose types cannot be trusted.
RAW_REVIEW_TEXT = T.StructType(
    [T.StructField(f.name, T.StringType()) for f in RAW_REVIEW.fields]
)

# Column sets written by the preparation jobs.
SAMPLE_COLUMNS = (
    "rating", "text", "title", "parent_asin", "helpful_vote", "verified_purchase", "timestamp",
)
SPLIT_COLUMNS = ("rating", "text", "parent_asin", "main_category", "sentiment", "cleaned_text")
VECTOR_META_COLUMNS = ("sentiment", "main_category", "parent_asin")


def resolve_text_column(df: DataFrame, requested: str = "cleaned_text") -> str:
    """The requested column, else ``cleaned_text``, else ``text``, else an error."""
    for name in (requested, "cleaned_text", "text"):
        if name in df.columns:
            return name
    raise ValueError(f"no text column: neither '{requested}', 'cleaned_text' nor 'text' exists")


def require_column(df: DataFrame, column: str, what: str) -> None:
    if column not in df.columns:
        raise ValueError(f"missing {what} column '{column}'")
