"""The registered queries against their SQL, and the pipeline stage by stage."""

import pathlib
import sys

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import language_id, near_dedup
from lexiloom.llm.queries import QUERIES, SQL
from tests.compare import check, connect

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert check(spark, connect(SF), SF, QUERIES[name], SQL[name]) is None


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op9_language_id"](spark, SF).join(docs, "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    out = QUERIES["op5_quality"](spark, SF).join(labels, "doc_id")
    assert out.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.9


def test_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(90_001, "12 34", None, None, 5), (90_002, None, None, None, 0)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).select(*corpus_pipeline.COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    spoken = stages["language_id"](spark, docs, SF).cache()
    assert {90_001, 90_002} & {r.doc_id for r in spoken.collect()} == set() and spoken.count() >= 0.98 * (docs.count() - 2)
    lines = stages["line_dedup"](spark, spoken, SF).cache()
    assert lines.columns == list(corpus_pipeline.COLUMNS) and lines.agg(F.sum("n_chars")).first()[0] < spoken.agg(F.sum(F.length("text"))).first()[0]
    single = stages["near_dedup"](spark, lines, SF).cache()
    left = near_dedup.near_duplicates(single, sketch=near_dedup.Sketch(words=5))
    assert 0 < single.count() < lines.count() and left.where("not kept").count() == 0
    clean = stages["decontamination"](spark, single, SF).cache()
    assert 0 < clean.count() < single.count()
    mixed = stages["source_mix"](spark, clean, SF)
    assert mixed.where("taken <> size * copies or copies < 1").count() == 0 and mixed.count() > 0
    assert stages["language_id"](spark, docs.limit(0), SF).count() == 0
    assert language_id.UNDETERMINED not in {r[0] for r in clean.select("lang").collect()}


def test_items_of_a_few_words_drop_nothing(spark, tmp_path):
    import corpus_pipeline

    ten = "one two three four five six seven eight nine ten"
    items = [(1, "the"), (2, "tiny item"), (3, None), (4, ten)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(
        [(1, "the clean text", None, None, 0), (2, "tiny item " * 6, None, None, 0), (3, f"the {ten} more", None, None, 0)],
        "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [1, 2]


STAGE_DOC = "doc_id long, text string, lang string, source string, n_chars long, _h string, n_dropped string"


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated ids and rows, and columns with the names of results."""
    from tests.llm.test_operators import prose

    a, b = prose(41, 60), prose(42, 60)
    rows = [(1, a, "x", "s", 1, "q", "q"), (5, a, "x", "s", 1, None, "q"), (5, b, "x", None, 1, "q", "q"), (7, b, None, "s", None, "q", None),
            (9, prose(43, 50), "x", "s", 1, "q", "q"), (9, prose(43, 50), "x", "s", 1, "q", "q"), (None, prose(44, 50), "x", "t", 1, "q", "q"),
            (4, None, None, None, None, None, None), (8, "", "x", "s", 0, "q", "q"), (11, " \t\n ", "x", "s", 4, "q", "q"), (12, prose(45, 20_000), "x", "s", 1, "q", "q")]
    return spark.createDataFrame(rows, STAGE_DOC), a, b


def test_every_stage_takes_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs, a, b = odd_documents(spark)
    spark.createDataFrame([(1, None), (None, "tiny"), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        if name != "source_mix":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        ids = sorted(str(r.doc_id) for r in rows)
        if name == "language_id":
            assert ids == sorted(["1", "5", "5", "7", "9", "9", "None", "12"])
        if name == "near_dedup":
            assert sorted((str(r.doc_id), (r.text or "")[:20]) for r in rows) == sorted(
                [("1", a[:20]), ("5", b[:20]), ("9", next(r.text for r in docs.collect() if r.doc_id == 9)[:20]), ("None", rows and next(r.text for r in docs.collect() if r.doc_id is None)[:20]),
                 ("4", ""), ("8", ""), ("11", " \t\n "), ("12", next(r.text for r in docs.collect() if r.doc_id == 12)[:20])])
        if name in ("line_dedup", "decontamination"):
            assert len(rows) == docs.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_the_language_stage_drops_garbled_and_foreign_texts(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    planted = [(90_001, "zzqx jjkv wwpq xxrr qqzz vvkj"), (90_002, "Русский текст, которого здесь не учили"), (90_003, "日本語の文章です"), (90_004, None)]
    both = docs.union(spark.createDataFrame([(i, t, None, None, 0) for i, t in planted], docs.schema))
    left = {r.doc_id for r in corpus_pipeline.language(spark, both, SF).select("doc_id").collect()}
    clean = {r.doc_id for r in docs.where("text is not null").select("doc_id").collect()}
    assert not left & {i for i, _ in planted} and len(left & clean) >= 0.99 * len(clean)
