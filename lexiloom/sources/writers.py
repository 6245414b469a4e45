"""Sinks. Every writer returns the path it wrote."""

from __future__ import annotations

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.schema import VECTOR_META_COLUMNS

# Fixed value: rows per file of the chunked sink.
CHUNK_ROWS = 50_000


def write_table(df: DataFrame, path: str, by: str | None = None) -> str:
    """Parquet; ``by`` gives one folder per value, e.g. per split.

    Rows are not shuffled by the folder column: a hot value is written by many tasks.
    """
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return path


def write_chunks(df: DataFrame, path: str, rows_per_file: int = CHUNK_ROWS) -> str:
    """Parquet in files of a bounded number of rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return path


def write_report_csv(df: DataFrame, path: str) -> str:
    """A report table as one CSV file with header; for aggregated results only."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_summary_json(df: DataFrame, path: str) -> str:
    """A one-row summary as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_jsonl(df: DataFrame, path: str, gzip: bool = False) -> str:
    writer = df.write.mode("overwrite").option("ignoreNullFields", False)
    (writer.option("compression", "gzip") if gzip else writer).json(path)
    return path


def write_vectors(df: DataFrame, path: str, vector: str = "vector", key: str = "row_id") -> str:
    """Vectors with their key and whichever label columns exist."""
    labels = [c for c in VECTOR_META_COLUMNS if c in df.columns]
    df.select(key, *labels, F.col(vector).cast("array<float>").alias(vector)).write.mode(
        "overwrite"
    ).parquet(path)
    return path


def save_model(model: MLWritable, path: str) -> str:
    model.write().overwrite().save(path)
    return path
