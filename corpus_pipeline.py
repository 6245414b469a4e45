"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents the stage before it kept, and returns what it keeps
with the columns of documents; the last one returns the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontamination, language_id, line_dedup, mixing, near_dedup
from lexiloom.llm.common import WORD, written

BROADCAST_ROWS = 500_000  # ids with a hash sent to every task at most; more are joined by a shuffle
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty ones too) and those whose letters are those of no learned
    language: garbled text and languages without a label, by the share of familiar letter sequences. Learns from
    all labels given; without any, all documents go. Short texts of a learned language stay.

    Rows are judged by themselves, whatever their ids: repeated and null ones change nothing. Further columns go.
    """
    judged = language_id.predict_languages(docs, language_id.fit_languages(docs))
    return judged.where("known").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes frequent lines out of all documents but one. A document of nothing else goes with its last line; one that
    was blank before stays, a null text as ''.

    Rows that repeat the id which keeps a line all keep it; a null id is smaller than any other. n_chars is counted
    anew. An empty table stays empty, further columns go.
    """
    left = line_dedup.dedup_lines(docs).where((F.col("n_dropped") == 0) | (F.col("text").rlike(WORD)))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, on shingles of five words.

    Rows are told apart by id and text: of exact repeated rows one stays, and no row goes because another one with its
    id does. Null and empty texts are copies of nothing and stay. A null id yields to any other. An empty
    table stays empty, further columns go.
    """
    return near_dedup.keep_one_of_each(docs.select(*COLUMNS), sketch=near_dedup.Sketch(words=5))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item. Items of fewer words drop nothing.

    Rows are judged by their own text, whatever their ids; null and empty texts and all rows of an empty
    benchmark stay. An empty table stays empty, further columns go.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where(F.size(decontamination.words_of("text")) >= 10)
    marked = docs.select(*COLUMNS, F.xxhash64("text").alias("_mark"))
    judged = decontamination.decontaminate(marked.select("doc_id", "_mark", "text"), items)
    leaks = written(judged.where("contaminated").select(F.col("doc_id").alias("_id"), F.col("_mark").alias("_of")).distinct(), "leaks")
    if leaks.count() <= BROADCAST_ROWS:
        leaks = F.broadcast(leaks)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_of"))
    return marked.join(leaks, same, "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many times each document is taken, and its words, by source weights.

    A null source is one, the last. Documents without a word have nothing to take and go, as do those that
    the sampling passes over. Repeated rows and null ids are documents like others. An empty table stays empty.
    """
    return mixing.mix(docs).where("copies > 0").select("doc_id", "source", "size", "copies", "taken")


STAGES = [
    ("language_id", language), ("line_dedup", lines), ("near_dedup", near_copies),
    ("decontamination", benchmark_leaks), ("source_mix", mix),
]

# SQL cannot express the first stage, which learns; tests hold the later ones against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
