"""TF-IDF: documents -> vocabulary, documents -> sparse rows, and the same as (document, term, weight).

Both steps are row-local. Fitting counts terms batch by batch and ships one row per term and batch, so a term found
in every document costs a row per batch; document and corpus frequency come from one aggregation. Transforming
counts a document's known terms, weighs them and divides by the norm in one pass over the texts, against a
broadcast vocabulary of bounded size: neither texts nor weights are shuffled. A vocabulary without such a bound is
joined term by term instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions import text as tx
from lexiloom.operators.sampling import hash_rank
from lexiloom.session import cut_lineage

# A vocabulary of at most this many terms is broadcast (tens of MB).
BROADCAST_TERMS = 200_000
BROADCAST_KEYS = 500_000  # keys that stand in several rows
COUNTED_WORDS = 2_000_000  # words a task holds before it passes on its counts
_SPACES = re.compile(tx.SPACES, re.ASCII)


@dataclass(frozen=True)
class TermSettings:
    """Vocabulary settings; the defaults are those of the main representation."""

    max_features: int | None = 100_000
    min_df: int = 5
    max_df: float = 0.95
    low: int = 1
    high: int = 2
    sublinear_tf: bool = True
    stop_words: tuple[str, ...] = ()


# Settings of the cluster keyword report.
KEYWORD_SETTINGS = dict(max_features=30_000, min_df=15, max_df=0.70)


def row_terms(text: str | None, s: TermSettings, stop_words: frozenset[str]) -> list[str]:
    """``functions.text.terms`` of one text: words of two or more characters, no stop words, then n-grams."""
    words = [w for w in _SPACES.split(text or "") if len(w) >= tx.MIN_TERM_LENGTH and w not in stop_words]
    out = list(words) if s.low == 1 else []
    for n in range(max(2, s.low), s.high + 1):
        out += map(" ".join, zip(*(words[i:] for i in range(n))))
    return out


def _counted(texts: list[pa.ListArray], s: TermSettings) -> Iterator[pa.RecordBatch]:
    """(term, df, cf) of the ``row_terms`` of some texts, given as their words. Words and n-grams are counted as numbers."""
    sizes = np.concatenate([t.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for t in texts])
    words = pa.concat_arrays([t.flatten() for t in texts]).dictionary_encode()
    names, code = words.dictionary, words.indices.to_numpy().astype(np.int64)
    known = pc.and_(pc.greater_equal(pc.utf8_length(names), tx.MIN_TERM_LENGTH),
                    pc.invert(pc.is_in(names, pa.array(s.stop_words, pa.string())))).to_numpy(zero_copy_only=False)
    kept = known[code]
    code, doc = code[kept], np.repeat(np.arange(len(sizes)), sizes)[kept]
    at, gram = np.arange(len(code)), code  # where n-grams begin, and their numbers
    for n in range(1, s.high + 1):
        if n > 1:
            whole = at + n - 1 < len(code)
            at, gram = at[whole], gram[whole]
            whole = doc[at] == doc[at + n - 1]
            at, gram = at[whole], gram[whole]
            if n > 2:
                gram = np.unique(gram, return_inverse=True)[1]
            gram = gram * len(names) + code[at + n - 1]
        if not len(at):
            break
        if n < s.low or (n == 1 and s.low != 1):
            continue
        order = np.argsort(gram, kind="stable")  # keeps the order of documents
        ordered, owner = gram[order], doc[at[order]]
        new = np.append(True, ordered[1:] != ordered[:-1])
        first = np.flatnonzero(new)
        cf = np.diff(np.append(first, len(ordered)))
        df = np.add.reduceat((new | np.append(True, owner[1:] != owner[:-1])).astype(np.int64), first)
        begin = at[order[first]]
        for low in range(0, len(first), 50_000):
            some = begin[low : low + 50_000]
            parts = [names.take(pa.array(code[some + i])) for i in range(n)]
            term = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
            yield pa.record_batch([term, pa.array(df[low : low + 50_000]), pa.array(cf[low : low + 50_000])], names=["term", "df", "cf"])


def term_statistics(
    df: DataFrame, text: str = "cleaned_text", settings: TermSettings = TermSettings()
) -> DataFrame:
    """(term, df, cf): documents containing the term, occurrences overall."""
    s = settings

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in (batch.column(0).slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                held.append(pc.ascii_split_whitespace(part))
                size += len(held[-1].flatten())
                if size > COUNTED_WORDS:
                    yield from _counted(held, s)
                    held, size = [], 0
        if held:
            yield from _counted(held, s)

    counted = df.select(text).mapInArrow(count, "term string, df long, cf long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def term_summary(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """Per key: terms, distinct_terms, first_term and last_term over all its rows; keys without a term are left out.

    A row's terms are summed up where they are. Only of keys with several rows are the terms themselves shuffled, to
    tell which of them are the same.
    """
    one = lambda t: F.struct(
        F.size(t).cast("long").alias("terms"), F.size(F.array_distinct(t)).cast("long").alias("distinct_terms"),
        F.array_min(t).alias("first_term"), F.array_max(t).alias("last_term"))
    # A transform of one element binds the terms, so that they are made once.
    own = df.select(key, F.element_at(F.transform(F.array(terms), one), 1).alias("_o"))
    summed = cut_lineage(own.groupBy(key).agg(
        F.sum("_o.terms").alias("terms"), F.max("_o.distinct_terms").alias("distinct_terms"),
        F.min("_o.first_term").alias("first_term"), F.max("_o.last_term").alias("last_term"),
        F.count_if(F.col("_o.terms") > 0).alias("_rows")))
    single = summed.filter("_rows = 1").drop("_rows")
    several = summed.filter("_rows > 1").drop("_rows", "distinct_terms").withColumnRenamed(key, "_k")
    several_keys, n = several.select("_k"), several.count()
    if n == 0:
        return single
    few = F.broadcast(several_keys) if n <= BROADCAST_KEYS else several_keys
    found = df.join(few, df[key].eqNullSafe(F.col("_k")), "left_semi").select(key, F.explode(terms).alias("_t"))
    distinct = found.groupBy(key).agg(F.count_distinct("_t").alias("distinct_terms"))
    return single.unionByName(distinct.join(several, distinct[key].eqNullSafe(F.col("_k"))).select(*single.columns))


def fit_vocabulary(
    df: DataFrame, text: str = "cleaned_text", settings: TermSettings = TermSettings()
) -> DataFrame:
    """(term, df, cf, idf): frequency limits, then the most frequent ``max_features`` terms.

    The number of documents counts empty ones too. Terms are counted once: the histogram of ``most_frequent`` and
    whoever reads the vocabulary again find the counts, and the capped vocabulary, stored.
    """
    n = df.agg(F.count("*")).scalar()
    stats = term_statistics(df, text, settings).filter(
        (F.col("df") >= settings.min_df) & (F.col("df") <= settings.max_df * n)
    )
    if settings.max_features is not None:
        stats = cut_lineage(most_frequent(cut_lineage(stats), settings.max_features))
    return stats.withColumn("idf", F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0)


def most_frequent(stats: DataFrame, n: int) -> DataFrame:
    """The n terms with the highest corpus frequency, ties by term.

    A histogram over frequency levels (a few hundred rows) shows below which level
    no term can be among them, so little more than n rows reach the final sort.
    """
    level = F.floor(F.log2("cf") * 8)
    higher = W.orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, -1)
    levels = stats.groupBy(level.alias("level")).agg(F.count("*").alias("n")).withColumn(
        "above", F.coalesce(F.sum("n").over(higher), F.lit(0))
    )
    lowest = levels.filter(F.col("above") < n).agg(F.min("level")).scalar()
    return stats.filter(level >= lowest).orderBy(F.desc("cf"), "term").limit(n)


def with_term_ids(vocabulary: DataFrame) -> DataFrame:
    """Add dense term ids 0..n-1."""
    return (
        hash_rank(vocabulary, "term", name="_rank")
        .withColumn("term_id", (F.col("_rank") - 1).cast("int"))
        .drop("_rank")
    )


def sparse_documents(
    df: DataFrame, vocabulary: DataFrame, key: str, text: str = "cleaned_text",
    settings: TermSettings = TermSettings(), carry=(), keep_empty: bool = False,
) -> DataFrame:
    """(key, carried columns, terms, [indices,] tf, weights): a document's known terms in order of their ids, or of
    their names, with unit length. Documents without a known term are left out, or kept with empty lists.

    The vocabulary has to be bounded by ``max_features`` up to ``BROADCAST_TERMS``; it is sent to every executor.
    """
    s, spark = settings, df.sparkSession
    if s.max_features is None or s.max_features > BROADCAST_TERMS:
        raise ValueError(f"set max_features, up to {BROADCAST_TERMS}, or use tfidf_weights")
    numbered = "term_id" in vocabulary.columns
    known = vocabulary.select("term", "idf", *(["term_id"] if numbered else [])).orderBy(
        "term_id" if numbered else "term").limit(s.max_features).toArrow()
    names = known.column("term").to_pylist()
    ids = known.column("term_id").to_numpy() if numbered else np.arange(len(names))
    sent = spark.sparkContext.broadcast((names, ids, known.column("idf").to_numpy()))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, idf = sent.value
        place, stop = {t: i for i, t in enumerate(names)}, frozenset(s.stop_words)
        listed = pa.array(names, pa.string())
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                found = [[i for t in row_terms(body.as_py(), s, stop) if (i := place.get(t)) is not None]
                         for body in part.column(part.num_columns - 1)]
                rows = np.flatnonzero([keep_empty or len(f) > 0 for f in found])
                if not len(rows):
                    continue
                counted = [np.unique(np.array(found[r], dtype=np.int64), return_counts=True) for r in rows]
                sizes = np.array([len(at) for at, _ in counted])
                at, tf = (np.concatenate(x) for x in zip(*counted))
                raw = (np.log(tf) + 1.0 if s.sublinear_tf else tf.astype(float)) * idf[at]
                begin = np.cumsum(sizes) - sizes
                norm = np.sqrt(np.bincount(np.repeat(np.arange(len(rows)), sizes), raw * raw, len(rows)))
                weight = raw / np.repeat(norm, sizes)
                ends = pa.array(np.append(begin, len(at)).astype(np.int32))
                lists = [listed.take(pa.array(at)), *([pa.array(ids[at].astype(np.int32))] if numbered else []),
                         pa.array(tf.astype(np.int64)), pa.array(weight)]
                own = [part.column(i).take(pa.array(rows)) for i in range(part.num_columns - 1)]
                yield pa.record_batch([*own, *(pa.ListArray.from_arrays(ends, x) for x in lists)], names=[*columns])

    own = df.select(key, *carry)
    fields = {f"`{f.name}`": f.dataType.simpleString() for f in own.schema}
    fields |= {"terms": "array<string>"} | ({"indices": "array<int>"} if numbered else {}) | {"tf": "array<bigint>", "weights": "array<double>"}
    columns = [n.strip("`") for n in fields]
    return df.select(key, *carry, text).mapInArrow(weigh, ", ".join(f"{n} {k}" for n, k in fields.items()))


def tfidf_weights(
    df: DataFrame, vocabulary: DataFrame, key: str, text: str = "cleaned_text",
    settings: TermSettings = TermSettings(), carry=(),
) -> DataFrame:
    """(key, carried columns, term, [term_id,] tf, weight); unit length per document.

    Terms outside the vocabulary are dropped, so this also transforms documents
    of other splits with a vocabulary fitted elsewhere.
    """
    s = settings
    ids = ["term_id"] if "term_id" in vocabulary.columns else []
    if s.max_features is not None and s.max_features <= BROADCAST_TERMS:
        return long_weights(sparse_documents(df, vocabulary, key, text, s, carry), key, carry)
    # No bound on the vocabulary: texts are dealt by key before their terms, several times larger, are joined.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(key, *carry, text).repartition(parts, key)
    found = docs.select(
        key, *carry, F.explode(tx.terms(text, s.low, s.high, s.stop_words)).alias("term")
    )
    counts = (
        found.join(vocabulary.select("term", *ids, "idf"), "term")
        .groupBy(key, *carry, "term", *ids, "idf")
        .agg(F.count("*").alias("tf"))
    )
    tf = F.log(F.col("tf").cast("double")) + 1.0 if s.sublinear_tf else F.col("tf")
    raw = counts.withColumn("_raw", tf * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(W.partitionBy(key)))
    return raw.select(
        key, *carry, "term", *ids, "tf", (F.col("_raw") / norm).alias("weight")
    )


def long_weights(rows: DataFrame, key: str, carry=()) -> DataFrame:
    """The rows of ``sparse_documents`` as ``tfidf_weights``: (key, carried columns, term, [term_id,] tf, weight)."""
    ids = ["term_id"] if "indices" in rows.columns else []
    lists = F.arrays_zip("terms", *(["indices"] if ids else []), "tf", "weights")
    return rows.select(key, *carry, F.explode(lists).alias("_t")).select(
        key, *carry, F.col("_t.terms").alias("term"), *([F.col("_t.indices").alias("term_id")] if ids else []),
        F.col("_t.tf").alias("tf"), F.col("_t.weights").alias("weight"))


def tfidf(
    df: DataFrame, key: str, text: str = "cleaned_text", settings: TermSettings = TermSettings(),
    carry=(),
) -> DataFrame:
    """Fit on ``df`` and transform it."""
    return tfidf_weights(df, fit_vocabulary(df, text, settings), key, text, settings, carry)


def sparse_rows(weights: DataFrame, key: str, carry=()) -> DataFrame:
    """One row per document: parallel arrays ``indices`` (sorted) and ``weights``.

    ``weights`` are long rows (term_id, weight) or those of ``sparse_documents``, whose lists are shuffled as they are.
    """
    if "indices" in weights.columns:
        lists = F.collect_list(F.struct("indices", "weights"))
        both = F.sort_array(F.flatten(F.transform(
            "_l", lambda x: F.arrays_zip(x["indices"].alias("term_id"), x["weights"].alias("weight")))))
        # A key of several documents has the entries of all of them.
        merged = F.transform(F.array(both), lambda p: F.struct(p["term_id"].alias("indices"), p["weight"].alias("weights")))
        return (
            weights.groupBy(key, *carry).agg(lists.alias("_l"))
            .select(key, *carry, F.when(F.size("_l") == 1, F.col("_l")).otherwise(merged)[0].alias("_m"))
            .select(key, *carry, "_m.indices", "_m.weights")
        )
    pairs = F.sort_array(F.collect_list(F.struct("term_id", "weight")))
    return (
        weights.groupBy(key, *carry)
        .agg(pairs.alias("_p"))
        .select(
            key,
            *carry,
            F.transform("_p", lambda p: p["term_id"]).alias("indices"),
            F.transform("_p", lambda p: p["weight"]).alias("weights"),
        )
    )


def feature_summary(vocabulary: DataFrame, docs: DataFrame, split: str = "split") -> DataFrame:
    """Rows per split and the number of features."""
    return (
        docs.groupBy(split)
        .agg(F.count("*").alias("rows"))
        .withColumn("features", vocabulary.agg(F.count("*")).scalar())
    )


def cluster_terms(
    df: DataFrame,
    key: str,
    cluster: str,
    text: str = "cleaned_text",
    settings: TermSettings = TermSettings(**KEYWORD_SETTINGS),
    top_n: int = 8,
    digits: int = 9,
) -> DataFrame:
    """Per cluster the terms whose mean weight exceeds the overall mean the most.

    Documents without a term count as weight 0, so the lift of a term a cluster
    never uses is minus its overall mean; the grid of clusters and vocabulary
    terms is therefore complete.
    """
    # One aggregation of the weighed documents gives all sums; a document counts at its first term, or at none.
    if settings.max_features is not None and settings.max_features <= BROADCAST_TERMS:
        rows = sparse_documents(
            df, fit_vocabulary(df, text, settings), key, text, settings, [cluster], keep_empty=True)
        entries = rows.select(cluster, F.posexplode_outer(F.arrays_zip("terms", "weights")).alias("_n", "_t")).select(
            cluster, F.col("_t.terms").alias("term"), F.col("_t.weights").alias("weight"),
            (F.coalesce("_n", F.lit(0)) == 0).cast("long").alias("_first"))
    else:
        weights = tfidf(df, key, text, settings, carry=[cluster])
        entries = weights.select(cluster, "term", "weight", F.lit(0).cast("long").alias("_first")).union(
            df.select(cluster, F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(1).cast("long")))
    every = cut_lineage(entries.groupBy(cluster, "term").agg(
        F.sum("weight").alias("_sum"), F.sum("_first").alias("_docs")))
    sums = every.filter("term is not null")
    sizes = every.groupBy(cluster).agg(F.sum("_docs").alias("_docs"))
    listed = sizes.agg(F.collect_list(F.struct(F.col(cluster).alias("c"), F.col("_docs").alias("n"))))
    per_term = sums.groupBy("term").agg(
        F.sum("_sum").alias("_total"),
        F.map_from_entries(F.collect_list(F.struct(cluster, "_sum"))).alias("_by_cluster"),
    )
    grid = per_term.select("term", "_total", "_by_cluster", F.explode(listed.scalar()).alias("g"))
    n = sizes.agg(F.sum("_docs")).scalar()
    own = F.coalesce(F.try_element_at("_by_cluster", F.col("g.c")), F.lit(0.0))
    lifts = grid.select(
        F.col("g.c").alias(cluster),
        "term",
        F.round(own / F.col("g.n") - F.col("_total") / n, digits).alias("lift"),
    )
    order = W.partitionBy(cluster).orderBy(F.desc("lift"), "term")
    return lifts.withColumn("term_rank", F.row_number().over(order)).filter(
        F.col("term_rank") <= top_n
    )


def joined_terms(ranked: DataFrame, cluster: str) -> DataFrame:
    """The ranked terms of each cluster as one comma-separated string."""
    pairs = F.sort_array(F.collect_list(F.struct("term_rank", "term")))
    return ranked.groupBy(cluster).agg(
        F.array_join(F.transform(pairs, lambda p: p["term"]), ", ").alias("top_terms")
    )
