import pytest
from pyspark.sql import functions as F

from lexiloom.operators import reports, rows, sampling, splits


@pytest.fixture(scope="module")
def table(spark):
    """A group that holds a third of the rows, many small ones, and a missing key."""
    return spark.range(6000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 1, None)
        .otherwise(F.concat(F.lit("g"), (F.col("id") % 500).cast("string"))).alias("group"),
        (F.col("id") % 4).alias("category"),
    )


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_exact_is_the_same_for_any_layout(table):
    for n in (0, 100, 10_000):
        a = ids(sampling.exact(table.repartition(1), n, "id"))
        b = ids(sampling.exact(table.repartition(7), n, "id"))
        assert a == b and len(a) == min(n, 6000)


def test_bucketed_sample_equals_the_sorted_one(table):
    for n in (1, 777, 5999, 6000, 9000):
        small = ids(sampling.exact(table, n, "id"))
        assert ids(sampling.exact_per_group(table, n, "id", digits=2)) == small


def test_large_samples_go_by_buckets(table, monkeypatch):
    monkeypatch.setattr(sampling, "TOP_N_LIMIT", 50)
    assert len(ids(sampling.exact(table, 51, "id"))) == 51


def test_per_group_counts_with_hot_and_missing_groups(table):
    got = {r["group"]: r["n"] for r in sampling.exact_per_group(table, 5, "id", ["group"])
           .groupBy("group").agg(F.count("*").alias("n")).collect()}
    assert got["hot"] == 5 and got[None] == 1 and max(got.values()) == 5
    assert len(got) == table.select("group").distinct().count()


def test_too_few_rows_is_an_error(table):
    with pytest.raises(ValueError, match="fewer than 7000"):
        sampling.exact_after_dedup(table, 7000, "category", "id")


def test_smallest_class_sample(table):
    uneven = table.filter("category <> 2 OR id < 40")
    counts = sampling.smallest_class_sample(uneven, 100, "id", "category").groupBy("category").count()
    assert {r["count"] for r in counts.collect()} == {10}


def test_row_cap(table):
    assert sampling.row_cap(table, None, "id") is table
    assert sampling.row_cap(table, 10, "id").count() == 10
    assert sampling.row_cap(table, 10**6, "id").count() == 6000


def test_fraction_is_repeatable(table):
    a, b = ids(sampling.fraction(table, 0.25, "id")), ids(sampling.fraction(table.repartition(3), 0.25, "id"))
    assert a == b and 1300 < len(a) < 1700


def test_keep_probability_is_capped(table):
    got = sampling.keep_probability(table, "category", 10_000).collect()
    assert {r["keep_prob"] for r in got} == {1.0}


def test_row_ids_are_dense(table):
    got = sorted(r["row_id"] for r in rows.with_row_id(table, "id").collect())
    assert got == list(range(6000))


def test_groups_stay_in_one_split(table):
    for split in (splits.by_group, splits.by_group_exact):
        done = split(table, "group")
        assert splits.leaked_groups(done, "group").count() == 0
        assert done.count() == 6000
        assert {r["split"] for r in done.select("split").distinct().collect()} == {"train", "val", "test"}


def test_exact_split_counts_groups(table):
    n = table.select("group").distinct().count()
    got = {r["split"]: r["g"] for r in splits.by_group_exact(table, "group", 0.2, 0.1)
           .groupBy("split").agg(F.count_distinct(F.coalesce("group", F.lit("?"))).alias("g")).collect()}
    test = -(-n * 2 // 10)
    assert got["test"] == test and got["val"] == -(-(n - test) // 8)
    assert sum(got.values()) == n


def test_split_without_group_column(table):
    done = splits.by_group(table.drop("group"), "group", row_key="id")
    assert done.count() == 6000
    with pytest.raises(ValueError):
        splits.by_group(table.drop("group"), "group")


def test_alignment_report(spark):
    v = spark.createDataFrame([(1,), (2,), (3,)], "row_id long")
    m = spark.createDataFrame([(2,), (3,), (4,), (5,)], "row_id long")
    assert tuple(rows.alignment_report(v, m).collect()[0]) == (2, 2, 1)


def test_drop_duplicates_keeps_the_first(table):
    kept = reports.drop_duplicates(table, ["group"], ["id"])
    got = {r["group"]: r["id"] for r in kept.collect()}
    assert got["hot"] == 0 and got[None] == 1 and got["g2"] == 2


def test_mode_takes_the_smallest_value_on_ties(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "z")], "k string, v string")
    got = {r["k"]: (r["size"], r["m"], r["m_share"]) for r in reports.group_mode(df, "k", "v", "m").collect()}
    assert got == {"a": (2, "x", 0.5), "b": (1, "z", 1.0)}


def test_describe(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double")
    r = reports.describe(df, ["x"]).collect()[0].asDict()
    assert (r["count"], r["min"], r["p50"], r["max"]) == (3, 1.0, 2.0, 4.0)
    assert r["p25"] == 1.5 and r["mean"] == pytest.approx(7 / 3)


def test_exact_percentiles_with_a_hot_value(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.concatenate([np.full(3000, 7.0), rng.normal(0, 100, 4000), rng.integers(0, 50, 2001)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(6)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    for cells in (3, 200):
        got = {r["share"]: r["value"] for r in reports.exact_percentiles(df, "x", shares, cells).collect()}
        assert [got[p] for p in shares] == pytest.approx(list(np.quantile(x, shares)), abs=1e-12)
    assert reports.exact_percentiles(df.limit(0), "x", shares).count() == 0
    empty = reports.describe(df.limit(0), ["x"]).collect()[0]
    assert empty["count"] == 0 and empty["p50"] is None

def test_percentiles_of_several_columns_cut_again_until_cells_are_small(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, 3000), np.concatenate([np.full(2990, 5.0), rng.normal(5, 1e-9, 10)])
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)],
                               "a double, b double, c double").repartition(4)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    out = reports.exact_percentiles(df, ["a", "b", "c"], shares, cells=4, most=20).collect()
    got = {(r["column"], r["share"]): r["value"] for r in out}
    assert len(out) == len(got) == 10
    for name, x in (("a", a), ("b", b)):
        assert [got[name, p] for p in shares] == pytest.approx(list(np.quantile(x, shares)), abs=1e-12)
