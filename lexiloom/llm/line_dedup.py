"""Line deduplication over levelled, sorted runs of line hashes."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lexiloom.llm.common import SPACES, written
from lexiloom.session import ship_package


def line_key(line: str) -> bytes:
    """The line without ASCII spaces at its ends, A-Z lower-cased, as UTF-8."""
    return line.strip(SPACES).encode("utf-8", "surrogatepass").lower()


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _hashes(min_chars: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, counts = batch.column(0), [], []
            for text in batch.column(1):
                lines = (text.as_py() or "").split("\n")
                # The strip leaves at most the line's length: short lines need no key.
                found = {_digest(line_key(x)) for x in lines
                         if len(x) >= min_chars and len(x.strip(SPACES)) >= min_chars}
                out.extend(found)
                counts.append(len(found))
            keys = np.frombuffer(b"".join(out), dtype="<i8").reshape(-1, 2)
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.record_batch([pa.array(keys[:, 0]), pa.array(keys[:, 1]), ids.take(at)],
                                  names=["k1", "k2", "doc"])
    return f


def lines_of(docs: DataFrame, min_chars: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, doc): 128-bit hashes of the distinct long keys of every row."""
    ship_package(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    return slim.mapInArrow(_hashes(min_chars), f"k1 long, k2 long, doc {kind}")


def counted(lines: DataFrame) -> DataFrame:
    """(k1, k2, docs, last) of (k1, k2, doc): documents and the largest one of each key, from partial sums."""
    return lines.groupBy("k1", "k2").agg(F.count("*").alias("docs"), F.max("doc").alias("last"))


class LineRuns:
    """Runs of (key, documents, largest document, first), each sorted by key, in levels.

    A batch is anti-joined with the runs: keys that no run holds are its ``first`` rows, the others add to a key's
    count. It becomes a run of level 0. When a level holds ``fanout`` runs they are merged into one of the next level,
    a row a key, so n batches leave about fanout * log(n) runs and each key is rewritten once per level.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    def _run(self, df: DataFrame, level: int) -> None:
        run = written(df.sortWithinPartitions("k1", "k2"), f"run-{level}")
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self._merged(self.levels[level]), []
            self._run(merged, level + 1)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        both = runs[0]
        for r in runs[1:]:
            both = both.union(r)
        if len(runs) == 1:
            return both
        return both.groupBy("k1", "k2").agg(
            F.sum("docs").alias("docs"), F.max("last").alias("last"), F.max("first").alias("first"))

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds a batch's (k1, k2, doc) as a run; returns its new keys (k1, k2, last), in no run before."""
        batch = written(counted(lines).sortWithinPartitions("k1", "k2"), "counted")
        new = written(self.unseen(batch).select("k1", "k2", "last"), "new-keys")
        marked = batch.join(new.select("k1", "k2", F.lit(True).alias("first")).hint("merge"), ["k1", "k2"], "left")
        self._run(marked.select("k1", "k2", "docs", "last", F.coalesce("first", F.lit(False)).alias("first")), 0)
        return new

    def totals(self) -> DataFrame | None:
        """One row per key over all runs; None before the first batch."""
        runs = [r for level in self.levels for r in level]
        return self._merged(runs) if runs else None

    def runs(self) -> list[int]:
        """Runs per level."""
        return [len(level) for level in self.levels]

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Rows whose key (k1, k2) is in no run: one merge-anti-join per run."""
        for level in self.levels:
            for run in level:
                lines = lines.join(run.hint("merge"), ["k1", "k2"], "left_anti")
        return lines


def later_copies(lines: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of (k1, k2, doc) that are not the first one of their key: all of known keys, and of new ones those
    of other documents than the largest."""
    first = new.select("k1", "k2", "last", F.lit(True).alias("_new"))
    return lines.join(first, ["k1", "k2"], "left").where(
        F.col("_new").isNull() | ~F.col("doc").eqNullSafe(F.col("last"))).select("k1", "k2", "doc")


def _cut(dropped: str, text: str):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != dropped]
            kept, before, after = [], [], []
            for body, keys in zip(batch.column(text), batch.column(dropped)):
                lines = left = (body.as_py() or "").split("\n")
                if keys.is_valid:
                    gone = {struct.pack("<qq", x["k1"], x["k2"]) for x in keys.as_py()}
                    left = [x for x in lines if _digest(line_key(x)) not in gone]
                kept.append("\n".join(left))
                before.append(len(lines))
                after.append(len(lines) - len(left))
            columns = [pa.array(kept, pa.string()) if n == text else batch.column(n) for n in names]
            yield pa.record_batch([*columns, pa.array(before, pa.int64()), pa.array(after, pa.int64())],
                                  names=[*names, "n_lines", "n_dropped"])
    return f


def drop_lines(docs: DataFrame, drops: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines whose (k1, k2) ``drops`` names for their doc; adds n_lines
    and n_dropped. Keys are gathered per document, so no more than its lines; text moves once."""
    ship_package(docs.sparkSession)
    per_doc = drops.groupBy(F.col("doc").alias("_doc")).agg(
        F.collect_set(F.struct("k1", "k2")).alias("_gone"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "_gone", "_doc")]
    joined = docs.select(*own).join(
        per_doc, docs[key].eqNullSafe(F.col("_doc")), "left").select(*own, "_gone")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != "_gone")
    return joined.mapInArrow(_cut("_gone", text), f"{fields}, n_lines long, n_dropped long")


def _batches(docs: DataFrame, key: str, n: int) -> list[Column]:
    """Conditions that cut the table at quantiles of the key, largest keys first; one batch if keys are no integers."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        return [F.lit(True)]
    cuts = docs.select(F.percentile_approx(
        F.col(key).cast("long"), [i / n for i in range(1, n)], 1000)).first()[0] or []
    cuts, k, out = sorted(set(cuts), reverse=True), F.col(key).cast("long"), []
    for i, cut in enumerate(cuts):
        out.append((k > cut) & (k <= cuts[i - 1]) if i else k > cut)
    return [*out, (k <= cuts[-1]) | k.isNull() if cuts else F.lit(True)]


def dedup_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, batches: int = 4,
                fanout: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines of every text that other documents repeat taken out.

    A line's key is the line without ASCII spaces at its ends and with A-Z lower-cased. Keys of at
    least ``min_chars`` code points that at least ``min_docs`` documents hold stay only in the document
    with the largest id. Adds n_lines (before) and n_dropped, replaces the text; columns of these names are replaced.

    Batches come by falling id. Each anti-joins the runs of the batches before: the largest document of a key that
    no run holds has its first copy, all others hold later ones. Then the batch adds its own run, compacted by level.
    Later copies go whose key is frequent over all runs. Counts are summed before they are shuffled, and the joins may
    split a hot key. Ids are of any type with an order; integers are cut into batches, others make one.

    A null text is one empty line and comes back as ''. Rows count as documents, also if they repeat an id; all rows
    of the largest id keep the line. A null id is smaller than any other. Texts of any length are read whole by one
    task each. An empty table gives an empty one. Nothing else of a row changes.
    """
    store, later = LineRuns(docs.sparkSession, fanout), None
    for part in _batches(docs, key, batches):
        lines = written(lines_of(docs.where(part), min_chars, key, text), "lines")
        copies = written(later_copies(lines, store.add(lines)), "later-copies")
        later = copies if later is None else later.union(copies)
    frequent = written(store.totals().where(F.col("docs") >= min_docs).select("k1", "k2").sortWithinPartitions("k1", "k2"), "frequent")
    drops = later.join(frequent, ["k1", "k2"]).select("doc", "k1", "k2")
    return drop_lines(docs, drops, key, text)


def add_batch(store: LineRuns, docs: DataFrame, *, min_chars: int = 40, key: str = "doc_id",
              text: str = "text") -> DataFrame:
    """One step of a growing corpus: ``docs`` without lines that earlier batches hold; then
    the batch's own keys join the store. Of copies within the batch the largest id keeps the line."""
    lines = written(lines_of(docs, min_chars, key, text), "lines")
    drops = written(later_copies(lines, store.add(lines)), "drops")
    return drop_lines(docs, drops, key, text)
