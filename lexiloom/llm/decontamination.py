"""Benchmark decontamination by winnowed word k-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import ascii_lower, written

# Fixed value: everything below 0x80 but digits and a-z separates words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_PLACES = 60_000  # fingerprints of the benchmark, with their words, that may be sent to every task


def words_of(text: Column | str) -> Column:
    """Lower-cased words of a text; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _hashed(df: DataFrame, k: int) -> DataFrame:
    """Adds ``_h``, the hash of every word, and ``_g``, that of the k words from each on, as far as there are k."""
    hashed = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    starts = F.slice("_h", 1, F.greatest(F.size("_h") - (k - 1), F.lit(0)))
    nth = lambda x, i: F.xxhash64(x, *[F.get("_h", i + j) for j in range(1, k)])
    return hashed.withColumn("_g", F.transform(starts, nth))


def _while(holds: list[Column]) -> Column:
    """How many of the conditions hold before the first that does not."""
    out = None
    for n, condition in enumerate(holds):
        broken = ~F.coalesce(condition, F.lit(False))
        out = F.when(broken, n) if out is None else out.when(broken, n)
    return out.otherwise(len(holds)) if holds else F.lit(0)


def _winnowed(k: int, window: int) -> Column:
    """Places of the kept k-grams: those whose hash is the smallest, of equal ones the first, in a window of words.

    A gram is kept if the grams beside it that are larger, with itself, make up a window. Equal windows keep the
    same gram wherever they stand, so a shared span of ``window`` words always shares a fingerprint; of n grams about
    2 n / (window - k + 2) are kept.
    """
    reach = window - k
    places = F.when(F.size("_g") > reach, F.sequence(F.lit(0), F.size("_g") - 1)).otherwise(F.array().cast("array<int>"))
    g = lambda i: F.get("_g", i)
    return F.filter(places, lambda i: _while([g(i - j) > g(i) for j in range(1, reach + 1)])
                    + _while([g(i + j) >= g(i) for j in range(1, reach + 1)]) >= reach)


def _spots(k: int, window: int, lengths: list[int]) -> Column:
    """Fingerprints (f, n, at) of a text: the kept grams, and for each of ``lengths`` all runs of so many words."""
    long = F.transform(_winnowed(k, window), lambda i: F.struct(F.get("_g", i).alias("f"), F.lit(window).alias("n"), i.alias("at")))
    return F.concat(long, *[_runs_of(n) for n in lengths])


def _runs_of(n: int) -> Column:
    """All runs of n words, as fingerprints."""
    places = F.when(F.size("_h") >= n, F.sequence(F.lit(0), F.size("_h") - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(
        F.xxhash64(*[F.get("_h", i + j) for j in range(n)]).alias("f"), F.lit(n).alias("n"), i.alias("at")))


def _with_words(spots: DataFrame, k: int, window: int) -> DataFrame:
    """Adds ``words``, those of all windows that hold the gram at ``at``, and how far the gram is ``back`` in them; a
    run of fewer words than a window is alone."""
    back = F.when(F.col("n") == window, F.least("at", F.lit(window - k))).otherwise(0)
    size = F.when(F.col("n") == window, F.col("back") + window).otherwise(F.col("n"))
    return spots.withColumn("back", back).withColumn("words", F.slice("_w", F.col("at") - F.col("back") + 1, size))


def item_places(items: DataFrame, k: int, window: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """(f, n, i_back, i_words, item): the fingerprints of the items; an item of fewer words than a window is one run."""
    rows = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words_of(text).alias("_w"))
    short = [rows.where(F.size("_w") == n).select("item", "_w", F.explode(F.array(F.struct(
        F.xxhash64(*[F.xxhash64(F.get("_w", F.lit(j))) for j in range(n)]).alias("f"), F.lit(n).alias("n"), F.lit(0).alias("at")))).alias("s"))
        for n in range(1, window)]
    # The outer form: for the inner one the optimizer repeats the array's expression in a filter.
    out = _hashed(rows.where(F.size("_w") >= window), k).select("item", "_w", F.explode_outer(_spots(k, window, [])).alias("s"))
    for part in short:
        out = out.union(part)
    return _with_words(out.where("s is not null").select("item", "_w", "s.*"), k, window).select(
        "f", "n", F.col("back").alias("i_back"), F.col("words").alias("i_words"), "item").distinct()


def find_hits(docs: DataFrame, places: DataFrame, k: int, window: int, lengths: list[int], small: bool) -> DataFrame:
    """(_key, _hash, at, n, place): stretches of the rows (_key, _hash, text) that hold windows of ``places``.

    Documents and items meet at equal fingerprints; a hit is then extended to both sides as far as the words
    agree, within the windows that hold it, and counts if that makes a window. Small sets of places are
    broadcast: the text is read once, nothing of it is shuffled, and rows without a match end in the scan stage.
    Otherwise fingerprints alone are shuffled, once per document and value, and only rows they meet are read again.
    """
    of = places.select("f", "n", "i_back", "i_words", "place").distinct()
    rows = _hashed(docs.select("_key", "_hash", words_of("text").alias("_w")), k)
    spots = F.explode_outer(_spots(k, window, lengths)).alias("s")
    if small:
        # Words are cut out behind the join, so for matches alone.
        found = rows.select("_key", "_hash", "_w", spots).select("_key", "_hash", "_w", "s.*").join(F.broadcast(of), ["f", "n"])
        found = _with_words(found, k, window)
    else:
        marks = F.array_distinct(F.transform(_spots(k, window, lengths), lambda s: s["f"]))
        met = (rows.select("_key", "_hash", F.explode_outer(marks).alias("f"))
               .join(of.select("f").distinct(), "f", "left_semi")
               .groupBy("_key", "_hash").agg(F.collect_set("f").alias("_met"))
               .withColumnsRenamed({"_key": "_k2", "_hash": "_h2"}))
        rows = rows.join(met, F.col("_key").eqNullSafe(F.col("_k2")) & (F.col("_hash") == F.col("_h2")))
        at = rows.select("_key", "_hash", "_w", "_met", spots).where(F.array_contains("_met", F.col("s.f")))
        at = _with_words(at.select("_key", "_hash", "_w", "s.*"), k, window)
        found = at.select("_key", "_hash", "f", "n", "at", "back", "words").join(of, ["f", "n"])
    same = lambda j: F.get("words", F.col("back") + j) == F.get("i_words", F.col("i_back") + j)
    gram = F.lit(True)
    for j in range(k):
        gram = gram & F.coalesce(same(j), F.lit(False))
    left = _while([(F.col("back") >= j) & (F.col("i_back") >= j) & same(-j) for j in range(1, window - k + 1)])
    right = _while([same(k + j) for j in range(window - k)])
    long, short = F.col("n") == window, (F.col("n") < window) & (F.col("words") == F.col("i_words"))
    extended = found.withColumn("_l", F.when(long & gram, left)).withColumn("_r", F.when(F.col("_l").isNotNull(), right))
    size = F.when(long, F.col("_l") + k + F.col("_r")).when(short, F.col("n"))
    return extended.withColumn("_n", size).where((long & (F.col("_n") >= window)) | short).select(
        "_key", "_hash", (F.col("at") - F.coalesce("_l", F.lit(0))).alias("at"), F.col("_n").alias("n"), "place")


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, k: int = 5,
                  key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", broadcast_places: int = BROADCAST_PLACES) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256, contaminated and the hit spans to every row.

    A window is ``window`` consecutive words of an item, or all of a shorter one. A word inside any
    occurrence of a window is hit; n_items counts items with an occurring window. Of the hashes of ``k`` words only
    the smallest in each window is kept (winnowing), equal ones bring documents and items together, and comparing
    the words beside them extends a hit as far as it goes: ``spans`` lists (first word, words) of the hit stretches.

    Null texts have no words. Null item ids read as ''. Repeated rows get equal results: matches are
    kept per id and text, not per row. Empty tables give no hits. Columns of ``docs`` with the names of
    the results are replaced. Matches are gathered per document, never per window, so a passage that a
    third of all documents share costs a row for each of its occurrences and no more.
    """
    results = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")
    own = [c for c in docs.columns if c not in results]
    places = written(item_places(items, k, window, item, item_text).withColumn(
        "place", F.concat_ws(" ", "n", "i_back", F.array_join("i_words", " "))), "places")
    stats = places.agg(F.count_distinct("place"), F.collect_set(F.when(F.col("n") < window, F.col("n")))).first()
    small = stats[0] <= broadcast_places

    keyed = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("text"))
    hits = written(find_hits(keyed, places, k, window, sorted(stats[1]), small).distinct(), "hits")

    # Spans in order; each adds what reaches beyond the end so far.
    zero = F.struct(F.lit(0).alias("hit"), F.lit(-1).alias("end"))
    step = lambda a, s: F.struct(
        (a["hit"] + F.greatest(F.lit(0), s["at"] + s["n"] - F.greatest(a["end"], s["at"]))).alias("hit"),
        F.greatest(a["end"], s["at"] + s["n"]).alias("end"))
    merge = lambda a, s: F.when(
        (F.size(a) > 0) & (F.element_at(a, -1)["first"] + F.element_at(a, -1)["words"] >= s["at"]),
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(
            F.element_at(a, -1)["first"].alias("first"),
            (F.greatest(F.element_at(a, -1)["first"] + F.element_at(a, -1)["words"], s["at"] + s["n"])
             - F.element_at(a, -1)["first"]).alias("words"))))
    ).otherwise(F.concat(a, F.array(F.struct(s["at"].alias("first"), s["n"].alias("words")))))
    none = F.array().cast("array<struct<first:int,words:int>>")
    spans = hits.groupBy("_key", "_hash").agg(
        F.sort_array(F.collect_set(F.struct("at", "n"))).alias("_s")).select(
        F.col("_key").alias("_k1"), F.col("_hash").alias("_h1"),
        F.aggregate("_s", zero, step)["hit"].cast("long").alias("n_hit"),
        F.aggregate("_s", none, merge).alias("spans"))
    of_item = places.select("place", "item").distinct()
    found = (hits.select("_key", "_hash", "place").distinct()
             .join(of_item, "place")
             .groupBy("_key", "_hash").agg(F.sort_array(F.collect_set("item")).alias("_i")).select(
                 F.col("_key").alias("_k2"), F.col("_hash").alias("_h2"),
                 F.size("_i").cast("long").alias("n_items"), F.array_join("_i", ",").alias("_ids")))
    per_doc = spans.join(found, F.col("_k1").eqNullSafe(F.col("_k2")) & (F.col("_h1") == F.col("_h2")))

    rows = docs.select(*own, F.xxhash64(text).alias("_hash"),
                       F.size(words_of(text)).cast("long").alias("n_words"))
    joined = rows.join(per_doc, F.col(key).eqNullSafe(F.col("_k1")) & (F.col("_hash") == F.col("_h1")), "left")
    return joined.select(
        *own, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("_ids", F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        F.coalesce("spans", none).alias("spans"))
