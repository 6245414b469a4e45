"""What the operators of this package share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.session import shared_dir

# Fixed value: the ASCII whitespace that separates words.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column | str) -> Column:
    """A-Z to a-z; every other character stays, whatever the locale."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the folder all executors share; cuts its lineage.

    A reader that loses an executor reads the files again instead of repeating the work.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
