import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import casts, labels
from lexiloom.functions import text as tx
from lexiloom.operators import shaping

TEXTS = [
    None, "", "<b>", "<br\n/>", "5 < 6 > 4", "Café d'été!", "a b c", "İstanbul",
    "x\x00y\x1fz", "<p>Good</p>  PRODUCT,10/10", "   ", "tabs\tand\nlines", "<<a>>", "a<b",
]


def cleaned(text):
    """Direct reading of the cleaning rule, in Python."""
    if text is None:
        return ""
    t = re.sub(r"<[^>]+>", " ", text.lower())
    t = re.sub(r"[^a-z0-9\s]", " ", t)
    return re.sub(r"\s+", " ", t).strip()


def column(spark, values, schema="v string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")


def apply(spark, values, expression):
    df = column(spark, values).select("i", expression(F.col("v")).alias("o"))
    return [r["o"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_clean_text_cases(spark):
    assert apply(spark, TEXTS, tx.clean_text) == [cleaned(t) for t in TEXTS]


def test_clean_text_property(spark):
    alphabet = st.characters(codec="utf-8", exclude_categories=["Cs"])
    batches = st.lists(st.text(alphabet, max_size=30), min_size=200, max_size=200)

    @settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
    @given(batches)
    def run(texts):
        assert apply(spark, texts, tx.clean_text) == [cleaned(t) for t in texts]

    run()


def test_collapse_whitespace_unicode(spark):
    got = apply(spark, ["a   b ", "\t x \n\n y"], tx.collapse_whitespace)
    assert got == ["a b", "x y"]


def test_tokenize_bounds(spark):
    values = ["one two three", "a", "", None, "  spaced   out  "]
    assert apply(spark, values, lambda c: tx.tokenize(c, 2, 2)) == [
        ["one", "two"], [], [], [], ["spaced", "out"],
    ]
    assert apply(spark, values, lambda c: tx.tokenize(c))[0] == ["one", "two", "three"]


def test_terms_are_words_of_two_letters_then_pairs(spark):
    assert apply(spark, ["a good b product here", "x", "only"], tx.terms) == [
        ["good", "product", "here", "good product", "product here"], [], ["only"],
    ]
    three = apply(spark, ["aa bb cc"], lambda c: tx.terms(c, 1, 3))[0]
    assert three == ["aa", "bb", "cc", "aa bb", "bb cc", "aa bb cc"]


def test_stop_words_are_removed_before_pairs(spark):
    got = apply(spark, ["king of the hill"], lambda c: tx.terms(c, 1, 2, ("of", "the")))
    assert got == [["king", "hill", "king hill"]]


def test_strip_accents(spark):
    values = ["Crème brûlée", "plain", None, "ﬁne"]
    want = [
        None if v is None else "".join(
            c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))
        for v in values
    ]
    assert apply(spark, values, tx.strip_accents) == want


def test_category_from_path(spark):
    paths = ["/data/raw/Electronics.jsonl.gz", "Sports_and_Outdoors.json", "/x/a.b/File.parquet"]
    assert apply(spark, paths, tx.category_from_path) == [
        "Electronics", "Sports_and_Outdoors", "File",
    ]


def test_sentiment_bands(spark):
    values = [1.0, 2.0, 2.5, 3.0, 5.0, None, float("nan")]
    df = column(spark, values, "v double").select("i", labels.sentiment("v").alias("s"))
    got = [r["s"] for r in df.orderBy("i").collect()]
    assert got == ["negative", "negative", "positive", "neutral", "positive", "positive", "positive"]


def test_canonical_category(spark):
    values = ["Home & Kitchen", "home_and_kitchen", "BEAUTY", "Sports_and_Outdoors", "Books", "x y"]
    assert apply(spark, values, labels.canonical_category) == [
        "Home_and_Kitchen", "Home_and_Kitchen", "Beauty_and_Personal_Care",
        "Sports_and_Outdoors", "Books", "x y",
    ]
    assert labels.canonical_names(["home kitchen", "Toys"]) == ["Home_and_Kitchen", "Toys"]


def test_category_scope_strict_and_lenient(spark):
    df = column(spark, ["electronics", "Books", "Home & Kitchen"]).withColumnRenamed("v", "main_category")
    lenient = shaping.category_scope(df, ["Electronics", "Home_and_Kitchen"], strict=False)
    assert sorted(r["main_category"] for r in lenient.collect()) == ["Electronics", "Home_and_Kitchen"]
    with pytest.raises(ValueError, match="Books"):
        shaping.category_scope(df, ["Electronics", "Home_and_Kitchen"], what="train")
    with pytest.raises(ValueError, match="missing category column"):
        shaping.category_scope(df, ["Electronics"], column="nope")


def test_casts(spark):
    df = spark.createDataFrame([("1.9", "maybe", "1700000000123"), ("n/a", None, "x")], "a string, b string, c string")
    rows = df.select(
        casts.to_number("a").alias("n"), casts.to_whole("a").alias("w"),
        casts.to_flag("b").alias("f"), casts.epoch_ms_to_time("c").cast("string").alias("t"),
    ).collect()
    assert tuple(rows[0]) == (1.9, 1, False, "2023-11-14 22:13:20.123")
    assert tuple(rows[1]) == (None, None, False, None)


def test_shape_review_fills_missing_columns(spark):
    df = spark.createDataFrame([("4", None)], "rating string, text string")
    row = shaping.shape_review(df, "Electronics").collect()[0]
    assert (row["rating"], row["text"], row["text_len"], row["verified_purchase"]) == (4.0, "", 0, False)
    assert row["category"] == "Electronics" and row["review_time"] is None


def test_sentiment_needs_a_source(spark):
    with pytest.raises(ValueError, match="neither"):
        shaping.with_sentiment(column(spark, ["x"]))


def test_empty_text_report(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "cleaned_text string")
    assert tuple(shaping.empty_text_report(df).collect()[0]) == (3, 2, pytest.approx(200 / 3))
    assert shaping.drop_empty_text(df).count() == 1
    assert shaping.empty_text_report(df.limit(0)).collect()[0]["dropped_percent"] is None


def test_case_types(spark):
    df = spark.createDataFrame(
        [(True, 3), (True, 2), (False, 1), (False, 0), (True, 1)], "t boolean, n int"
    ).select(labels.case_type("t", "n").alias("c"))
    assert [r["c"] for r in df.collect()] == ["success", "mixed", "mixed", "failure", "mixed"]
