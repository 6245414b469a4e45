"""Line-by-line acceptance of records as a stream of files.

Shaping a record, dropping empty text and the hash decision depend on one row
only, so there is no state, watermark or shuffle. The file sink and the query's
checkpoint make restarts exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions import hashing, labels
from lexiloom.functions import text as tx
from lexiloom.operators import shaping, splits
from lexiloom.plans.jobs import record_hash_key
from lexiloom.schema import RAW_REVIEW
from lexiloom.sources.writers import CHUNK_ROWS


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType = RAW_REVIEW, files_per_batch: int = 100
) -> DataFrame:
    """JSON-lines files as they arrive; a malformed line fails the batch."""
    return (
        spark.readStream.schema(schema).option("mode", "FAILFAST")
        .option("maxFilesPerTrigger", files_per_batch).json(folder)
    )


def accept(rows: DataFrame, category: str, keep_prob: float) -> DataFrame:
    """Shaped records with text whose hash falls below ``keep_prob``."""
    shaped = shaping.shape_review(rows, category).filter(F.col("text_len") > 0)
    return shaped.filter(hashing.keep_with_probability(record_hash_key(), keep_prob))


def label_clean_split(rows: DataFrame, seed=42) -> DataFrame:
    """Sentiment, cleaned text and split of streamed records."""
    out = rows.withColumns(
        {"sentiment": labels.sentiment("rating"), "cleaned_text": tx.clean_text("text")}
    )
    return splits.by_group(shaping.drop_empty_text(out), seed=seed)


def write_stream(
    rows: DataFrame, out: str, checkpoint: str, rows_per_file: int = CHUNK_ROWS
):
    """Append to parquet in bounded files, processing what is there and then stopping."""
    return (
        rows.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .option("maxRecordsPerFile", rows_per_file).trigger(availableNow=True).start()
    )
