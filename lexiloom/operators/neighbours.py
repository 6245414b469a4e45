"""Exact cosine nearest neighbours.

Two physical forms give the same rows, for dense and for sparse vectors:

* few queries (at most ``broadcast_queries``, checked): the query matrix is
  broadcast, each corpus partition keeps its k best per query with block matrix
  products, and a window over at most partitions * k rows per query finishes.
  One pass over the corpus, no shuffle of vectors.
* more queries: a partitioned kNN join. Bounded pivots cut the space into cells,
  cells into blocks of bounded size and, as long as a task can hold them, bounded number, and the triangle inequality decides which
  candidates can matter for which cell; only those are shipped. Work is per
  (query block, candidate block), so no task holds a whole cell, and a hot cell
  is split like any other. Of many exact copies only the k+1 lowest ids can ever
  be an answer, so the rest are not shipped as candidates; no result changes.

Scores are rounded to ``digits`` and ties go to the lower id, which makes the
answer unique. Vector pairs are never emitted, only each block's k best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions import vectors as vec
from lexiloom.operators import sampling
from lexiloom.session import cut_lineage

BROADCAST_QUERIES = 20_000
BLOCK_ROWS = 50_000
SPARSE_BLOCK_ROWS = 10_000
SUB_BLOCK_ROWS = 128
MAX_PIVOTS = 256
# Every block is sent to each block of the other side, so their number, not their size, stays fixed while rows grow.
MOST_BLOCKS = 8
BLOCK_VALUES = 1 << 22
SPARSE_MOST_ROWS = 65_536
MATRIX_TERMS = 2048
MATRIX_SHARE = 0.02
# Terms of so many queries are multiplied as a matrix, at most so many terms: their postings would be most of the work.
FREQUENT_SHARE = 0.05
FREQUENT_TERMS = 256
_SCORES_PER_CHUNK = 4_000_000
_DENSE_SCORES = 1_500_000
_SLACK = 1e-4


# ---------------------------------------------------------------- numpy helpers
def _matrix(column) -> np.ndarray:
    """List column to a unit-row matrix; zero rows stay zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    m = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    m = m.reshape(len(column), -1) if len(column) else m.reshape(0, 1)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _ids(column) -> np.ndarray:
    a = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return a.astype(str) if a.dtype == object else a


def rows_of_blocks(rows: int, block_rows: int, most: int) -> int:
    """Rows a block holds: ``block_rows``, or as many as make ``MOST_BLOCKS`` blocks, as long as a task can hold
    them (``most``). Up to MOST_BLOCKS * most rows a row is then shipped a bounded number of times."""
    return max(block_rows, min(most, math.ceil(rows / MOST_BLOCKS)))


class _Best:
    """The k best (score, id) of each query over any number of score blocks."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.q, self.s, self.i, self.rows = [], [], [], []
        self.size, self.limit = 0, 4 * queries * k + 100_000

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: pa.Table) -> None:
        width = scores.shape[1]
        hit = (scores >= self.floor[:, None]) & (scores > -np.inf)
        if width > self.k:
            # Only where k scores reach the floor can it rise.
            many = np.flatnonzero(hit.sum(axis=1) >= self.k)
            if len(many):
                some = scores[many]
                some.partition(width - self.k, axis=1)
                kth = some[:, width - self.k]
                self.floor[many] = np.maximum(self.floor[many], kth)
                hit[many] &= scores[many] >= self.floor[many, None]
        q, c = np.nonzero(hit)
        if len(q) == 0:
            return
        self.q.append(q), self.s.append(scores[q, c]), self.i.append(ids[c])
        self.rows.append(rows.take(pa.array(c)))
        self.size += len(q)
        if self.size > self.limit:
            self.trim()

    def trim(self) -> None:
        if not self.q:
            return
        q, s, i = np.concatenate(self.q), np.concatenate(self.s), np.concatenate(self.i)
        order = np.lexsort((i, -s, q))
        sorted_q = q[order]
        first = np.searchsorted(sorted_q, sorted_q, side="left")
        rank = np.arange(len(order)) - first
        keep = order[rank < self.k]
        full = order[rank == self.k - 1]
        self.floor[q[full]] = np.maximum(self.floor[q[full]], s[full])
        rows = pa.concat_tables(self.rows).take(pa.array(keep))
        self.q, self.s, self.i, self.rows = [q[keep]], [s[keep]], [i[keep]], [rows]
        self.size = len(keep)

    def table(self, query_ids: pa.Array) -> pa.Table | None:
        self.trim()
        if not self.q:
            return None
        found = self.rows[0]
        return pa.table(
            [query_ids.take(pa.array(self.q[0])), pa.array(self.s[0])]
            + [found.column(n) for n in found.column_names],
            names=["query_id", "score", *found.column_names],
        )


def _score_rows(best: _Best, unit_queries, query_index, rows: pa.Table, vector: str, opts) -> None:
    """Score one batch of candidate rows against all queries, chunk by chunk."""
    step = max(1, _DENSE_SCORES // max(1, len(unit_queries)))
    for start in range(0, rows.num_rows, step):
        part = rows.slice(start, step)
        ids = _ids(part.column("neighbor_id"))
        scores = unit_queries @ _matrix(part.column(vector)).T
        np.round(scores, opts["digits"], out=scores)  # in place: such a matrix is most of a task's memory
        scores += 0.0
        if opts["drop_exact"]:
            scores[scores >= 1.0] = -np.inf
        if query_index is not None:
            at = query_index.get_indexer(ids)
            own = np.nonzero(at >= 0)[0]
            scores[at[own], own] = -np.inf
        best.add(scores, ids, part.drop_columns([vector]))


# ---------------------------------------------------------------- public operator
def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "row_id",
    corpus_id: str = "row_id",
    vector: str = "vector",
    payload: Sequence[str] = (),
    exclude_self: bool = True,
    drop_exact: bool = False,
    digits: int = 9,
    broadcast_queries: int = BROADCAST_QUERIES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per query the k most similar corpus rows.

    Columns: query_id, neighbor_rank (1..k), neighbor_id, score, then the corpus
    columns named in ``payload``. ``exclude_self`` drops equal ids (one id space);
    ``drop_exact`` drops every score of 1, i.e. exact copies as well. Fewer than k
    rows come back when the corpus is smaller.
    """
    q = queries.select(F.col(query_id).alias("query_id"), vec.as_double(vector).alias("vector"))
    c = corpus.select(
        F.col(corpus_id).alias("neighbor_id"),
        *[F.col(p) for p in payload],
        vec.as_double(vector).alias("vector"),
    )
    opts = {"k": k, "digits": digits, "drop_exact": drop_exact, "exclude_self": exclude_self}
    few = q.limit(broadcast_queries + 1).toArrow() if broadcast_queries > 0 else None
    if few is not None and few.num_rows <= broadcast_queries:
        found = _by_broadcast(c, few, q.schema["query_id"], opts)
    else:
        found = _by_blocks(q, c, opts, block_rows)
    return _final_rank(found, k, payload)


def _final_rank(found: DataFrame, k: int, payload: Sequence[str]) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "neighbor_id")
    return (
        found.withColumn("neighbor_rank", F.row_number().over(order))
        .filter(F.col("neighbor_rank") <= k)
        .select("query_id", "neighbor_rank", "neighbor_id", "score", *payload)
    )


def _result_schema(query_field: T.StructField, c: DataFrame) -> T.StructType:
    rest = [f for f in c.schema.fields if f.name != "vector"]
    return T.StructType(
        [T.StructField("query_id", query_field.dataType), T.StructField("score", T.DoubleType())]
        + rest
    )


def _by_broadcast(c: DataFrame, few: pa.Table, query_field, opts) -> DataFrame:
    # Blocks of queries bound the score matrix a task holds at any time.
    sent = c.sparkSession.sparkContext.broadcast(
        (few.column("query_id").combine_chunks(), _matrix(few.column("vector")))
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, unit = sent.value
        index = pd.Index(_ids(query_ids)) if opts["exclude_self"] else None
        best = _Best(len(query_ids), opts["k"])
        if len(query_ids):
            for batch in batches:
                _score_rows(best, unit, index, pa.Table.from_batches([batch]), "vector", opts)
        out = best.table(query_ids)
        if out is not None:
            yield from out.to_batches(max_chunksize=10_000)

    return c.mapInArrow(scan, _result_schema(query_field, c))


# ---------------------------------------------------------------- sparse vectors
def nearest_sparse(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "row_id",
    corpus_id: str = "row_id",
    payload: Sequence[str] = (),
    exclude_self: bool = True,
    digits: int = 9,
    broadcast_queries: int = BROADCAST_QUERIES,
    block_rows: int = SPARSE_BLOCK_ROWS,
) -> DataFrame:
    """``nearest`` for unit-length sparse rows (columns ``indices`` and ``weights``).

    A query side of at most ``broadcast_queries`` rows (checked) is broadcast as postings (term -> queries); a corpus
    row only touches the postings of its own terms, and the most frequent terms are a matrix. More queries go through a join of blocks (``_sparse_by_blocks``),
    for which weights must not be negative; the rows are the same.
    """
    q = queries.select(F.col(query_id).alias("query_id"), "indices", "weights")
    c = corpus.select(
        F.col(corpus_id).alias("neighbor_id"), *payload, "indices", "weights"
    )
    few = q.limit(broadcast_queries + 1).toArrow() if broadcast_queries > 0 else None
    if few is None or few.num_rows > broadcast_queries:
        opts = {"k": k, "digits": digits, "exclude_self": exclude_self}
        return _final_rank(_sparse_by_blocks(q, c, opts, block_rows), k, payload)
    query_ids = few.column("query_id").combine_chunks()
    lengths = np.array([len(x) for x in few.column("indices")], dtype=np.int64)
    term = few.column("indices").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    weight = few.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(query_ids)), lengths)
    frequent = _frequent(term, len(query_ids))
    matrix = _as_matrix((owner, term, weight), len(query_ids), frequent) if len(frequent) else None
    by_term = np.argsort(term, kind="stable")
    by_term = by_term[~np.isin(term[by_term], frequent)]
    sent = c.sparkSession.sparkContext.broadcast(
        (query_ids, term[by_term], owner[by_term], weight[by_term], frequent, matrix)
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, p_term, p_owner, p_weight, frequent, matrix = sent.value
        index = pd.Index(_ids(query_ids)) if exclude_self else None
        n = len(query_ids)
        best = _Best(n, k)
        step = max(1, min(256, _SCORES_PER_CHUNK // max(1, n)))
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for start in range(0, whole.num_rows, step):
                part = whole.slice(start, step)
                width = part.num_rows
                idx = part.column("indices").combine_chunks()
                row = np.repeat(np.arange(width), idx.value_lengths().to_numpy(zero_copy_only=False))
                t = idx.flatten().to_numpy(zero_copy_only=False)
                w = part.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
                low = np.searchsorted(p_term, t, side="left")
                count = np.searchsorted(p_term, t, side="right") - low
                hit = np.repeat(np.arange(len(t)), count)
                before = np.cumsum(count) - count
                at = np.arange(len(hit)) - before[hit] + low[hit]
                scores = np.bincount(
                    p_owner[at] * width + row[hit], p_weight[at] * w[hit], minlength=n * width
                ).reshape(n, width).astype(float, copy=False)  # of no entries it makes integers
                if matrix is not None:
                    scores += matrix @ _as_matrix((row, t, w), width, frequent).T
                np.round(scores, digits, out=scores)
                scores += 0.0
                ids = _ids(part.column("neighbor_id"))
                if index is not None:
                    own_at = index.get_indexer(ids)
                    own = np.nonzero(own_at >= 0)[0]
                    scores[own_at[own], own] = -np.inf
                best.add(scores, ids, part.drop_columns(["indices", "weights"]))
        out = best.table(query_ids)
        if out is not None:
            yield from out.to_batches(max_chunksize=10_000)

    schema = T.StructType(
        [T.StructField("query_id", q.schema["query_id"].dataType),
         T.StructField("score", T.DoubleType())]
        + [f for f in c.schema.fields if f.name not in ("indices", "weights")]
    )
    return _final_rank(c.mapInArrow(scan, schema), k, payload)


def _frequent(term: np.ndarray, queries: int) -> np.ndarray:
    """The terms that stand in many of the queries, sorted."""
    terms, counts = np.unique(term, return_counts=True)
    many = np.flatnonzero(counts >= max(2, FREQUENT_SHARE * queries))
    return np.sort(terms[many[np.argsort(-counts[many], kind="stable")[:FREQUENT_TERMS]]])


# ---------------------------------------------------------------- sparse join of blocks
class _Sparse:
    """Sparse rows of a table as flat arrays: owner, term and weight of every entry, sorted by owner."""

    def __init__(self, rows: pa.Table):
        idx = rows.column("indices").combine_chunks()
        self.n = rows.num_rows
        self.term = idx.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.weight = rows.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.owner = np.repeat(np.arange(self.n), idx.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        self.begin = np.searchsorted(self.owner, np.arange(self.n + 1))
        if len(self.weight) and self.weight.min() < 0:
            raise ValueError("weights must not be negative; use at most broadcast_queries queries")

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in ``rows``, term, weight) of some rows' entries."""
        size = self.begin[rows + 1] - self.begin[rows]
        at = np.repeat(self.begin[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.repeat(np.arange(len(rows)), size), self.term[at], self.weight[at]


def _products(q, q_size: int, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
    """Dot products (q_size x width) of query entries ``q`` with columns given as postings sorted by term."""
    row, t, w = q
    low = np.searchsorted(term, t, side="left")
    count = np.searchsorted(term, t, side="right") - low
    hit = np.repeat(np.arange(len(t)), count)
    at = np.arange(len(hit)) - (np.cumsum(count) - count)[hit] + low[hit]
    return np.bincount(row[hit] * width + owner[at], w[hit] * weight[at], minlength=q_size * width).reshape(q_size, width)


def _as_matrix(entries, rows: int, terms: np.ndarray) -> np.ndarray:
    """Entries (row, term, weight) as a matrix over the sorted ``terms``; other terms are left out."""
    row, t, w = entries
    at = np.minimum(np.searchsorted(terms, t), len(terms) - 1)
    known = terms[at] == t
    return np.bincount(row[known] * len(terms) + at[known], w[known], minlength=rows * len(terms)).reshape(rows, -1)


def _score_sparse_block(queries: pa.Table, docs: pa.Table, opts, floors: np.ndarray) -> tuple[list, int]:
    """(query row, doc row, score) of the best positive scores that reach their query's floor, and products made.

    Documents are cut into sub-blocks of neighbours in the order of their heaviest term. Against the largest weight
    of each term in a sub-block a query has an upper bound for all its documents; below the floor, or without
    a common term, the sub-block is passed over for this query. Few terms that stand in many documents are
    multiplied as matrices, others by postings.
    """
    k, digits = opts["k"], opts["digits"]
    q, d = _Sparse(queries), _Sparse(docs)
    if not len(q.term) or not len(d.term):
        return [], 0
    floors = floors.copy()
    q_ids, d_ids = _ids(queries.column("query_id").combine_chunks()), _ids(docs.column("neighbor_id").combine_chunks())
    subs = -(-d.n // SUB_BLOCK_ROWS)
    sub = d.owner // SUB_BLOCK_ROWS
    order = np.lexsort((sub, d.term))
    t, o, w = d.term[order], sub[order], d.weight[order]
    first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (o[1:] != o[:-1])))
    top = (o[first], t[first], np.maximum.reduceat(w, first))
    half = 0.5 * 10.0 ** -digits
    terms = np.unique(d.term)
    matrix = len(terms) <= MATRIX_TERMS and len(d.term) >= MATRIX_SHARE * d.n * len(terms)
    found: list[tuple] = []
    made = 0
    step = max(1, min(4096, _SCORES_PER_CHUNK // max(subs, SUB_BLOCK_ROWS, len(terms) if matrix else 0)))
    for begin in range(0, q.n, step):
        rows = np.arange(begin, min(begin + step, q.n))
        if matrix:
            left = _as_matrix(q.of(rows), len(rows), terms)
            bound = left @ _as_matrix(top, subs, terms).T
        else:
            bound = _products(q.of(rows), len(rows), *top, subs)
        held: list[tuple] = []
        # The sub-blocks that promise most come first: they raise the floors for the rest.
        for s in np.argsort(-bound.max(axis=0), kind="stable"):
            at = np.flatnonzero((bound[:, s] > 0) & (bound[:, s] + 2 * half >= floors[rows]))
            if not len(at):
                continue
            asked = rows[at]
            some = np.arange(s * SUB_BLOCK_ROWS, min((s + 1) * SUB_BLOCK_ROWS, d.n))
            width = len(some)
            if matrix:
                scores = (left if len(at) == len(rows) else left[at]) @ _as_matrix(d.of(some), width, terms).T
            else:
                low, high = d.begin[some[0]], d.begin[some[-1] + 1]
                by_term = np.argsort(d.term[low:high], kind="stable")
                scores = _products(q.of(asked), len(asked), d.owner[low:high][by_term] - some[0],
                                   d.term[low:high][by_term], d.weight[low:high][by_term], width)
            made += scores.size
            if opts["exclude_self"]:
                scores[q_ids[asked][:, None] == d_ids[None, some]] = 0
            hit = (scores > 0) & (scores >= (floors[asked] - 2 * half)[:, None])
            if width > k:
                # Only where k scores reach the floor can it rise.
                many = np.flatnonzero(hit.sum(axis=1) >= k)
                if len(many):
                    kth = np.round(np.partition(scores[many], width - k, axis=1)[:, width - k], digits)
                    floors[asked[many]] = np.maximum(floors[asked[many]], kth)
            i, j = np.nonzero(hit)
            value = np.round(scores[i, j], digits)
            keep = (value > 0) & (value >= floors[asked][i])
            held.append((asked[i[keep]], some[j[keep]], value[keep]))
            if sum(len(x[0]) for x in held) > _SCORES_PER_CHUNK:
                held = [_top(held, d_ids, k)]
        if held:
            found.append(_top(held, d_ids, k))
    return found, made


def _top(held: list[tuple], d_ids: np.ndarray, k: int) -> tuple:
    q, d, s = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((d_ids[d], -s, q))
    q, d, s = q[order], d[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return q[keep], d[keep], s[keep]


def _sparse_by_blocks(q: DataFrame, c: DataFrame, opts, block_rows: int) -> DataFrame:
    """The positive scores that can be among a query's k best, and the lowest ids where fewer are positive.

    Rows are ordered by their heaviest term and cut into blocks, so that a block's rows share terms; a term that is
    the heaviest of many rows gets several; see ``rows_of_blocks`` for their size. Each query first meets a block of its own kind, which gives its k-th best
    score as a floor. Then blocks meet blocks, and floors and the largest weights of terms say what is passed over.
    """
    k = opts["k"]
    heaviest = F.array_max(F.zip_with("weights", "indices", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))["i"]
    kept = [f for f in c.columns if f not in ("indices", "weights")]
    q = cut_lineage(q.withColumn("kind", F.coalesce(heaviest.cast("long"), F.lit(-1).cast("long"))))
    c = cut_lineage(c.withColumn("kind", F.coalesce(heaviest.cast("long"), F.lit(-1).cast("long"))))
    q_rows, block_rows = (rows_of_blocks(x.count(), block_rows, SPARSE_MOST_ROWS) for x in (q, c))
    # One row per heaviest term, at most the vocabulary: where its rows begin in the order of terms.
    sizes = c.groupBy("kind").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum(F.when(F.col("n") < block_rows, F.col("n"))).over(W.orderBy("kind").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = cut_lineage(sizes.select(
        "kind", F.when(F.col("n") < block_rows, F.concat(F.lit("few-"), F.floor(before / block_rows).cast("string")))
        .otherwise(F.concat(F.lit("one-"), F.col("kind").cast("string"))).alias("place"),
        F.when(F.col("n") < block_rows, 1).otherwise(F.ceil(F.col("n") / block_rows)).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("neighbor_id"), F.col("parts")).cast("string")
    docs = c.join(places, "kind").withColumn("block", F.concat_ws("/", "place", part)).drop("place", "parts")
    asked = q.join(places.drop("parts"), "kind", "left").withColumn("place", F.coalesce("place", F.lit("none")))
    crowds = asked.groupBy("place").agg(F.ceil(F.count("*") / q_rows).alias("crowd"))
    asked = asked.join(crowds, "place").withColumn("q_block", F.concat_ws(
        "/", "place", F.pmod(F.xxhash64("query_id"), F.col("crowd")).cast("string"))).drop("crowd")
    docs, asked = cut_lineage(docs), cut_lineage(asked)

    rest = [f for f in c.schema.fields if f.name in kept]
    schema = T.StructType([T.StructField("query_id", q.schema["query_id"].dataType), T.StructField("score", T.DoubleType()), *rest])

    def score(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        corpus = corpus.sort_by([("kind", "ascending"), ("neighbor_id", "ascending")])
        floors = queries.column("floor").to_numpy() if "floor" in queries.column_names else np.zeros(queries.num_rows)
        found, _ = _score_sparse_block(queries, corpus, opts, floors)
        at = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        rows = corpus.select(kept).take(pa.array(at[1]))
        return pa.table([queries.column("query_id").take(pa.array(at[0])), pa.array(at[2]), *rows.columns], names=["query_id", "score", *kept])

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        # Both sides join the same pair list; new aliases keep their columns apart.
        right = right.select(*[F.col(n).alias(n) for n in right.columns])
        return left.groupBy("q_block", "block").cogroup(right.groupBy("q_block", "block")).applyInArrow(score, schema)

    blocks = cut_lineage(docs.select("block").distinct())
    q_blocks = asked.select("q_block", "place").distinct()
    home = q_blocks.withColumn("block", F.concat_ws("/", "place", F.lit("0"))).join(blocks, "block").select("q_block", "block")
    slim = asked.select("query_id", "indices", "weights", "q_block")
    first = cut_lineage(meet(slim.join(home, "q_block"), docs.join(home, "block")))
    best = W.partitionBy("query_id").orderBy(F.desc("score"))
    floors = first.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == k).select("query_id", F.col("score").alias("floor"))
    floored = slim.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    # Blocks without a common term never meet; what else can be passed over is found inside.
    terms = lambda df, b: df.select(b, F.explode(F.array_distinct("indices")).alias("t")).distinct()
    pairs = terms(slim, "q_block").join(terms(docs, "block"), "t").select("q_block", "block").distinct().join(
        home, ["q_block", "block"], "left_anti")
    pairs = cut_lineage(pairs)
    found = first.unionByName(meet(floored.join(pairs, "q_block"), docs.join(pairs, "block")))
    # Fewer than k positive scores: rows that share no term score 0, the lowest ids first. Of the 2k + 1 lowest
    # at most k - 1 are positive and one is the query.
    found = cut_lineage(found)
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
    lowest = c.select(*kept).orderBy("neighbor_id").limit(2 * k + 1).agg(F.collect_list(F.struct(*kept)))
    flat = q.select("query_id").join(enough, "query_id", "left_anti").select(
        "query_id", F.lit(0.0).alias("score"), F.explode(lowest.scalar()).alias("d")).select("query_id", "score", "d.*")
    flat = flat.join(found.select("query_id", "neighbor_id"), ["query_id", "neighbor_id"], "left_anti")
    if opts["exclude_self"]:
        flat = flat.filter(F.col("query_id") != F.col("neighbor_id"))
    return found.unionByName(flat.select(*found.columns))


# ---------------------------------------------------------------- partitioned kNN join
def _with_cells(df: DataFrame, pivots) -> DataFrame:
    """Add the nearest pivot and the distance to it."""
    schema = T.StructType(
        df.schema.fields
        + [T.StructField("cell", T.IntegerType()), T.StructField("reach", T.DoubleType())]
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for b in batches:
            if b.num_rows == 0:
                continue
            cos = _matrix(b.column(b.schema.get_field_index("vector"))) @ p.T
            cell = cos.argmax(axis=1)
            near = cos[np.arange(len(cell)), cell]
            reach = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * near))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(cell.astype(np.int32)), pa.array(reach)],
                names=[*b.schema.names, "cell", "reach"],
            )

    return df.mapInArrow(assign, schema)


def _cell_pairs(
    q_stats, c_stats, pivots: np.ndarray, k: int, block_rows: int, drop_exact: bool = False,
    q_block_rows: int | None = None,
) -> list[tuple]:
    """Which candidate cells can hold a neighbour of which query cell.

    ``limit`` bounds the distance to the (k+1)-th neighbour for every query in
    the cell: query to pivot, pivot to pivot, pivot to candidate. With ``drop_exact`` any number of
    the candidates may be copies of the query, so nothing is bounded and every cell is compared.
    """
    between = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (pivots @ pivots.T)))
    pairs = []
    for i, q in q_stats.items():
        ways = sorted(
            (q["reach"] + between[i, j] + c["reach"], c["rows"]) for j, c in c_stats.items()
        )
        limit, seen = math.inf, 0
        for way, rows in ways:
            seen += rows
            if seen >= k + 1 and not drop_exact:
                limit = way
                break
        for j, c in c_stats.items():
            gap = between[i, j] - q["reach"] - c["reach"]
            if gap <= limit + _SLACK:
                pairs.append(
                    (i, j, math.ceil(q["rows"] / (q_block_rows or block_rows)), math.ceil(c["rows"] / block_rows),
                     float(between[i, j]), float(q["reach"] + limit + _SLACK))
                )
    return pairs


def _by_blocks(q: DataFrame, c: DataFrame, opts, block_rows: int) -> DataFrame:
    spark, k = q.sparkSession, opts["k"]
    same_vector = W.partitionBy(F.xxhash64("vector"), "vector").orderBy("neighbor_id")
    live = c.filter(vec.is_nonzero("vector"))
    reduced = (
        live.withColumn("_copy", F.row_number().over(same_vector))
        .filter(F.col("_copy") <= k + 1)
        .drop("_copy")
    )

    size, longest = live.agg(F.count("*"), F.max(F.size("vector"))).first()
    most = BLOCK_VALUES // max(1, longest or 1)
    least_rows, block_rows = block_rows, rows_of_blocks(size, block_rows, most)
    want = max(1, min(MAX_PIVOTS, math.ceil(size / block_rows)))
    sample = sampling.exact(live.select("neighbor_id", "vector"), want, "neighbor_id", "pivots")
    unit = _matrix(sample.select("vector").toArrow().column("vector"))
    found = []
    if len(unit):
        pivots = spark.sparkContext.broadcast(unit)
        # Used by the cell statistics and by the join: computed once, reliably.
        q_cells = cut_lineage(_with_cells(q.filter(vec.is_nonzero("vector")), pivots))
        c_cells = cut_lineage(_with_cells(reduced, pivots))

        def stats(df: DataFrame) -> dict:  # at most MAX_PIVOTS rows
            rows = df.groupBy("cell").agg(
                F.count("*").alias("rows"), F.max("reach").alias("reach")
            )
            return {r["cell"]: r.asDict() for r in rows.collect()}

        q_stats = stats(q_cells)
        q_block_rows = rows_of_blocks(sum(r["rows"] for r in q_stats.values()), least_rows, most)
        pairs = _cell_pairs(q_stats, stats(c_cells), unit, k, block_rows, opts["drop_exact"], q_block_rows)
        if pairs:
            found.append(_join_blocks(spark, q, q_cells, c_cells, pairs, opts))
    # Zero vectors score 0 with everything: of those, only the k+1 lowest ids matter.
    fields = [n for n in c.columns if n != "vector"]

    def lowest(df: DataFrame):
        few = df.select(*fields).orderBy("neighbor_id").limit(k + 1)
        return few.agg(F.collect_list(F.struct(*fields))).scalar()

    flat = q.select(
        "query_id",
        F.lit(0.0).alias("score"),
        F.explode(
            F.when(
                vec.is_nonzero("vector"), lowest(c.filter(~vec.is_nonzero("vector")))
            ).otherwise(lowest(c))
        ).alias("n"),
    ).select("query_id", "score", *[F.col("n")[f].alias(f) for f in fields])
    if opts["exclude_self"]:
        flat = flat.filter(F.col("query_id") != F.col("neighbor_id"))
    found.append(flat)
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _join_blocks(spark, q, q_cells, c_cells, pairs, opts) -> DataFrame:
    plan = F.broadcast(  # at most MAX_PIVOTS ** 2 rows
        spark.createDataFrame(
            pairs, "q_cell int, c_cell int, q_blocks int, c_blocks int, apart double, bound double"
        )
    )
    block_key = ["q_cell", "q_block", "c_cell", "c_block"]
    # Both sides join the same pair list; new aliases keep their columns apart.
    fresh = [F.col(n).alias(n) for n in block_key]

    def block(id_col: str, blocks: str):
        return F.pmod(F.xxhash64(id_col), F.col(blocks).cast("long")).cast("int")

    left = (
        q_cells.join(plan, F.col("cell") == F.col("q_cell"))
        .withColumn("q_block", block("query_id", "q_blocks"))
        .withColumn("c_block", F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)))
        .select(*fresh, "query_id", "vector")
    )
    right = (
        c_cells.join(plan, F.col("cell") == F.col("c_cell"))
        .filter(F.abs(F.col("apart") - F.col("reach")) <= F.col("bound"))
        .withColumn("c_block", block("neighbor_id", "c_blocks"))
        .withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        .select(*fresh, *[n for n in c_cells.columns if n not in ("cell", "reach")])
    )

    def score(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        rows = candidates.drop_columns(block_key)
        ids = queries.column("query_id").combine_chunks()
        unit = _matrix(queries.column("vector"))
        out = []
        # Query slices bound the score matrix; a slice sees all candidates of the block.
        for start in range(0, len(ids), 4096):
            part = ids.slice(start, 4096)
            index = pd.Index(_ids(part)) if opts["exclude_self"] else None
            best = _Best(len(part), opts["k"])
            if rows.num_rows:
                _score_rows(best, unit[start : start + 4096], index, rows, "vector", opts)
            found = best.table(part)
            if found is not None:
                out.append(found)
        return pa.concat_tables(out) if out else empty.slice(0, 0)

    schema = _result_schema(q.schema["query_id"], c_cells.drop("cell", "reach"))
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema).empty_table()
    return (
        left.groupBy(*block_key).cogroup(right.groupBy(*block_key)).applyInArrow(score, schema)
    )
