"""Scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.schema import RAW_REVIEW, resolve_text_column

CORRUPT = "_malformed"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = RAW_REVIEW) -> DataFrame:
    """JSON lines; blank lines are skipped and a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_lenient(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RAW_REVIEW,
    partitions: int | None = None,
) -> DataFrame:
    """JSON lines without the malformed ones.

    The malformed text is kept in a helper column and filtered on, so the result
    does not depend on which columns the query goes on to read. A gzip file is a
    single split: give ``partitions`` to spread its rows before heavier work.
    """
    marked = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    rows = (
        spark.read.schema(marked)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    # Spark refuses a scan of the marker alone (e.g. for a count), so the filter reads a data
    # column too; its part is always true.
    first = F.coalesce(F.col(schema.fieldNames()[0]).cast("string"), F.lit(""))
    rows = rows.filter(F.col(CORRUPT).isNull() & (F.char_length(first) >= 0)).drop(CORRUPT)
    return rows.repartition(partitions) if partitions else rows


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet file, folder or glob."""
    return spark.read.parquet(path)


def load_model(path: str) -> PipelineModel:
    """A Spark pipeline model that ``writers.save_model`` wrote."""
    return PipelineModel.load(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header line and a declared schema."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_json_document(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """One JSON document per file, e.g. a run summary."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def text_or_empty(df: DataFrame, column: str = "cleaned_text", name: str = "text") -> DataFrame:
    """Text column with fallback; missing text becomes ''. Other columns are kept."""
    source = resolve_text_column(df, column)
    return df.withColumn(name, F.coalesce(F.col(source), F.lit("")))


def load_split(df: DataFrame, column: str = "cleaned_text") -> tuple[DataFrame, str]:
    """Text column with fallback, rows without text dropped; returns (rows, column name)."""
    source = resolve_text_column(df, column)
    return df.dropna(subset=[source]), source


def path_exists(spark: SparkSession, path: str) -> bool:
    """True once a table at ``path`` has been completely written."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def read_through(
    spark: SparkSession, path: str, compute: Callable[[], DataFrame]
) -> DataFrame:
    """The table at ``path`` if complete, else compute it, store it, and read it back.

    An interrupted write leaves no success marker, so it is computed again.
    """
    if not path_exists(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
