"""All rows whose cosine reaches a threshold: exact, without a cross join and without pairs of copies.

Rows of one direction form a class, held once. Bounded pivots cut the classes' space into cells; the angle between two
rows is at least the difference of their angles to a pivot, so a row is held against the cells that can hold
a partner, block by block. In a block the first dimensions are multiplied for all pairs, and only pairs whose
product plus the product of the remaining lengths can still reach the threshold are computed in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import vectors as vec
from lexiloom.operators import sampling
from lexiloom.operators.neighbours import BLOCK_VALUES, _ids, _matrix, rows_of_blocks
from lexiloom.session import cut_lineage

BLOCK_ROWS = 20_000
MAX_PIVOTS = 256
_SLACK = 1e-7
_ROWS_AT_ONCE = 256
# Gathering the rows of single pairs pays up to this share of all pairs.
_GATHERED = 0.1


def _survivors(left: np.ndarray, right: np.ndarray, least: float, prefix: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """``surviving_pairs``, a few rows of left at a time."""
    order = np.argsort(-(np.square(left).sum(0) + np.square(right).sum(0)), kind="stable")
    left, right = left[:, order], right[:, order]
    rest = np.sqrt(np.maximum(0, np.square(right[:, prefix:]).sum(1)))
    dense = False
    for at in range(0, len(left), _ROWS_AT_ONCE):
        some = left[at:at + _ROWS_AT_ONCE]
        if not dense:
            bound = some[:, :prefix] @ right[:, :prefix].T
            own = np.sqrt(np.maximum(0, np.square(some[:, prefix:]).sum(1)))
            i, j = np.nonzero(bound + own[:, None] * rest[None, :] >= least - _SLACK)
            # A prefix that says little about these rows is not asked again.
            dense = len(i) > _GATHERED * bound.size
        if dense:
            product = some @ right.T
            a, b = np.nonzero(product >= least - _SLACK)
            yield a + at, b, product[a, b], product.size
            continue
        for lot in range(0, len(i), 1 << 18):
            a, b = i[lot:lot + (1 << 18)], j[lot:lot + (1 << 18)]
            cosine = np.einsum("ij,ij->i", some[a], right[b])
            keep = cosine >= least - _SLACK
            yield a[keep] + at, b[keep], cosine[keep], len(a)


def surviving_pairs(left: np.ndarray, right: np.ndarray, least: float, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row of left, row of right, cosine, pairs computed in full) of unit rows that reach ``least``.

    Columns are taken in the order of their mass, so that a short prefix says much.
    """
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), 0), *_survivors(left, right, least, prefix)]
    i, j, cosine = (np.concatenate(x) for x in list(zip(*found))[:3])
    return i, j, cosine, sum(x[3] for x in found)


def _classes(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(h, way, class_id, members, unit): rows of one direction, by the smallest id, with its vector at unit length; zero
    vectors have none."""
    rows = df.select(F.col(key).alias("id"), vec.as_double(vector).alias("v")).where("id is not null").where(vec.is_nonzero("v"))
    unit = rows.select("id", vec.normalize("v").alias("u"))
    return unit.select("id", "u", F.transform("u", lambda x: F.round(x, 12)).alias("way")).groupBy(F.xxhash64("way").alias("h"), "way").agg(
        F.min("id").alias("class_id"), F.count("*").alias("members"), F.min_by("u", "id").alias("unit"))


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _meetings(df: DataFrame, least: float, key: str, vector: str, digits: int, block_rows: int, meet, schema: str) -> tuple[DataFrame, DataFrame]:
    """(classes, what ``meet`` makes of every two blocks that can hold linked classes).

    ``meet`` takes two tables (class_id, members, unit), and whether they are the same block. ``schema`` may name the
    type of a class_id as {id}. Blocks have ``block_rows`` rows, or more so that their number stays bounded
    (``rows_of_blocks``): each row is shipped to every block that can hold a partner.
    """
    if not 0 < least <= 1:
        raise ValueError("the threshold lies above 0, up to 1")
    spark = df.sparkSession
    classes = cut_lineage(_classes(df, key, vector))
    id_type = classes.schema["class_id"].dataType.simpleString()
    size, longest = classes.agg(F.count("*"), F.max(F.size("unit"))).first()
    block_rows = rows_of_blocks(size, block_rows, BLOCK_VALUES // max(1, longest or 1))
    want = max(1, min(MAX_PIVOTS, math.ceil(size / block_rows)))
    sample = sampling.exact(classes.select("class_id", "unit"), want, "class_id", "pivots")
    pivots = _matrix(sample.select("unit").toArrow().column("unit"))
    if not len(pivots):
        return classes, spark.createDataFrame([], schema.format(id=id_type))
    sent = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = _matrix(batch.column(2)) @ sent.value.T
                cell = cosine.argmax(axis=1)
                yield pa.record_batch(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(_angle(cosine[np.arange(len(cell)), cell])),
                     pa.array(_angle(cosine).tolist(), pa.list_(pa.float64()))], names=["class_id", "members", "unit", "cell", "reach", "angles"])

    placed = cut_lineage(classes.select("class_id", "members", "unit").mapInArrow(
        assign, f"class_id {id_type}, members long, unit array<double>, cell int, reach double, angles array<double>"))
    # At most MAX_PIVOTS rows: how many rows each cell has, and how far from its pivot they lie.
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(
        F.count("*").alias("rows"), F.min("reach").alias("near"), F.max("reach").alias("far")).collect()}
    table = spark.createDataFrame(
        [(c, math.ceil(r["rows"] / block_rows), float(r["near"]), float(r["far"])) for c, r in cells.items()],
        "other int, blocks int, near double, far double")
    widest = math.acos(max(-1.0, min(1.0, least - 10.0 ** -digits))) + _SLACK
    own = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    blocked = placed.join(F.broadcast(table.selectExpr("other AS cell", "blocks")), "cell").withColumn("block", own).drop("blocks", "reach")
    # A row visits the cells, itself at an angle to their pivots, in which a partner can lie; of two cells the one
    # with the smaller number is home, so that each pair of rows meets once.
    angle = F.element_at("angles", F.col("other") + 1)
    visits = blocked.join(F.broadcast(table), F.col("other") <= F.col("cell")).where(
        (angle - widest <= F.col("far")) & (angle + widest >= F.col("near"))).withColumn(
        "other_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(
        (F.col("other") < F.col("cell")) | (F.col("other_block") <= F.col("block")))
    # One visitor's block against one home block, so that no task holds more than two.
    guests = visits.select("other", "other_block", F.col("cell").alias("from"), F.col("block").alias("from_block"), "class_id", "members", "unit")
    pairs = guests.select("other", "other_block", "from", "from_block").distinct()
    homes = blocked.select(F.col("cell").alias("other"), F.col("block").alias("other_block"), "class_id", "members", "unit").join(
        pairs, ["other", "other_block"])
    # Both sides stem from the same table; new aliases keep their columns apart.
    homes = homes.select(*[F.col(n).alias(n) for n in homes.columns])
    names = ["other", "other_block", "from", "from_block"]

    def compare(guest: pa.Table, home: pa.Table) -> pa.Table:
        same = guest.num_rows and home.num_rows and guest.column("other")[0] == guest.column("from")[0] and (
            guest.column("other_block")[0] == guest.column("from_block")[0])
        return meet(guest, home, bool(same))

    return classes, guests.groupBy(*names).cogroup(homes.groupBy(*names)).applyInArrow(compare, schema.format(id=id_type))


def _reached(guest: pa.Table, home: pa.Table, least: float, digits: int, prefix: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of guest, row of home, rounded cosine) of the linked rows, a few rows of guest at a time."""
    for i, j, cosine, _ in _survivors(
            _matrix(guest.column("unit")), _matrix(home.column("unit")), least - 10.0 ** -digits, prefix):
        cosine = np.round(cosine, digits) + 0.0
        keep = cosine >= least
        yield i[keep], j[keep], cosine[keep]


def class_links(
    df: DataFrame, least: float, key: str = "row_id", vector: str = "vector", digits: int = 9,
    block_rows: int = BLOCK_ROWS, prefix: int = 16,
) -> tuple[DataFrame, DataFrame]:
    """(classes, links): (class_id, members, unit, …), and (class_a, class_b, cosine) of different classes, a < b,
    whose cosine, rounded to ``digits``, is ``least`` or more."""
    def links(guest: pa.Table, home: pa.Table, same: bool) -> pa.Table:
        x, y = (t.column("class_id").combine_chunks() for t in (guest, home))
        a, b = _ids(x), _ids(y)
        out = [pa.table([x.slice(0, 0), y.slice(0, 0), pa.array([], pa.float64())], names=["class_a", "class_b", "cosine"])]
        for i, j, cosine in _reached(guest, home, least, digits, prefix):
            # A block meets itself with every pair twice.
            up = a[i] < b[j]
            for way, (first, m), (second, n) in ((up, (x, i), (y, j)), (~up, (y, j), (x, i))):
                if way.any() and not (same and way is not up):
                    out.append(pa.table([first.take(pa.array(m[way])), second.take(pa.array(n[way])), pa.array(cosine[way])],
                                        names=["class_a", "class_b", "cosine"]))
        return pa.concat_tables(out)

    return _meetings(df, least, key, vector, digits, block_rows, links, "class_a {id}, class_b {id}, cosine double")


def class_link_counts(
    df: DataFrame, least: float, key: str = "row_id", vector: str = "vector", digits: int = 9,
    block_rows: int = BLOCK_ROWS, prefix: int = 16,
) -> tuple[DataFrame, DataFrame]:
    """(classes, counts): (class_id, linked) is the number of rows in the classes that ``class_links`` links with a class.

    Links are counted where they are found: a class has one row for each two blocks, however many links it has.
    """
    def counts(guest: pa.Table, home: pa.Table, same: bool) -> pa.Table:
        ids = [t.column("class_id").combine_chunks() for t in (guest, home)]
        a, b = map(_ids, ids)
        sizes = [t.column("members").to_numpy() for t in (guest, home)]
        linked = [np.zeros(len(x)) for x in ids]
        for i, j, _ in _reached(guest, home, least, digits, prefix):
            if same:
                other = a[i] != b[j]
                i, j = i[other], j[other]
            else:
                linked[1] += np.bincount(j, sizes[0][i], minlength=len(b))
            linked[0] += np.bincount(i, sizes[1][j], minlength=len(a))
        out = [pa.table([x.filter(pa.array(n > 0)), pa.array(n[n > 0].astype(np.int64))], names=["class_id", "linked"]) for x, n in zip(ids, linked)]
        return pa.concat_tables(out)

    classes, found = _meetings(df, least, key, vector, digits, block_rows, counts, "class_id {id}, linked long")
    return classes, found.groupBy("class_id").agg(F.sum("linked").alias("linked"))


def similar_rows(
    df: DataFrame, least: float, key: str = "row_id", vector: str = "vector", digits: int = 9,
    block_rows: int = BLOCK_ROWS, prefix: int = 16,
) -> DataFrame:
    """(key, class_id, n_links) of every row: the smallest id of its direction, and how many other rows reach
    ``least`` in cosine with it, its copies among them.

    Links are counted between classes and multiplied by their members, so a group of copies costs one row, and
    no link becomes a row of its own.
    Zero vectors are like nothing: a class of their own each, no links. Rows with a null key or vector are left out.
    ``class_links`` has the linked classes themselves.
    """
    classes, counted = class_link_counts(df, least, key, vector, digits, block_rows, prefix)
    named = classes.join(counted, "class_id", "left").select(
        "h", "way", "class_id", (F.coalesce("linked", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    rows = df.select(F.col(key).alias("id"), vec.as_double(vector).alias("v")).where("id is not null and v is not null")
    way = F.transform(vec.normalize("v"), lambda x: F.round(x, 12))
    keyed = rows.where(vec.is_nonzero("v")).select("id", way.alias("way")).withColumn("h", F.xxhash64("way"))
    zeros = rows.where(~vec.is_nonzero("v")).select(F.col("id").alias(key), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return keyed.join(named, ["h", "way"]).select(F.col("id").alias(key), "class_id", "n_links").union(zeros)
