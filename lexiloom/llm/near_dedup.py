"""Near-duplicate documents by SetSketch registers: band, estimate by likelihood, verify on full sets."""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import written
from lexiloom.llm.components import connected_components
from lexiloom.session import ship_package

BLOCK = 1 << 12  # shingles hashed at a time
REMEMBERED = 1 << 17  # word hashes a worker remembers
BROADCAST_IDS = 2_000_000  # document ids sent to every task at most
BROADCAST_ROWS = 500_000  # ids with a digest sent to every task at most


@dataclasses.dataclass(frozen=True)
class Sketch:
    """bands x rows registers of base ``base``; ``percent`` is the least similarity of a link.

    Two sets of similarity J agree in a band with about J**rows: at J = 0.8 and 40 bands of 5 rows a pair
    is missed once in ten million times. ``slack`` standard errors below the threshold the estimate still passes.
    """

    words: int = 2
    percent: int = 80
    bands: int = 40
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    slack: float = 5.0

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def least_size(self) -> int:
        """Smaller sets resemble no other set enough: n of n + 1 is the most two can share."""
        n = 1
        while 100 * n < self.percent * (n + 1):
            n += 1
        return n

    def least_estimate(self) -> float:
        """Pairs estimated below this are not verified."""
        j = self.percent / 100
        return j - self.slack * (j * (1 - j) / self.size) ** 0.5


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: int, memory: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``words`` words (all of a shorter text; none of an empty one).

    Words stand between ASCII spaces, A-Z lower-cased; on bytes, lower() and split() do just that.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(memory) > REMEMBERED:
        memory.clear()
    hashes = []
    for w in found:
        h = memory.get(w)
        if h is None:
            h = memory[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j:len(h) - n + 1 + j])
    return np.unique(out)


def registers(shingles: np.ndarray, s: Sketch) -> np.ndarray:
    """The set's registers, uint16: of each hash function's least value x (exponential of rate ``rate``) the
    exponent floor(1 - log_base x), cut to 16 bits. Registers of a union are the maxima of both sides'."""
    rng = np.random.default_rng(20)
    a = (rng.integers(1 << 32, size=s.size, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    b = rng.integers(1 << 32, size=s.size, dtype=np.uint64).astype(np.uint32)
    x = ((shingles >> np.uint64(32)) ^ (shingles * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32))).astype(np.uint32)
    least = np.full(s.size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), BLOCK):
        v = x[i:i + BLOCK, None] * a + b
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(16)
        np.minimum(least, v.min(axis=0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / s.rate
    return np.clip(np.floor(1 - np.log(x) / np.log(s.base)), 0, 65535).astype(np.uint16)


def band_keys(regs: np.ndarray, s: Sketch) -> np.ndarray:
    """(documents, bands) keys of (documents, size) registers."""
    parts = regs.reshape(len(regs), s.bands, s.rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, s.bands + 1, dtype=np.uint64), parts.shape[:2])
    for j in range(s.rows):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return out.view(np.int64)


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, s: Sketch) -> np.ndarray:
    """Most likely similarity of pairs from how many registers are larger on either side or equal,
    given both cardinalities. Over a grid of similarities, for all pairs at once."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (s.base - 1) / s.base) / np.log(s.base)
    # With J the shares of a union that only one side holds are (u - v J) and (v - u J).
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    score = (more[:, None] * np.log(up + tiny) + less[:, None] * np.log(down + tiny)
             + same[:, None] * np.log(np.clip(1 - up - down, tiny, None)))
    return j[np.arange(len(j)), score.argmax(1)]


def _identity(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signatures(s: Sketch):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, int] = {}
        for batch in batches:
            sizes, names, regs = [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), s.words, memory)
                sizes.append(len(found))
                names.append(_identity(found))
                regs.append(registers(found, s).tobytes() if len(found) >= s.least_size() else None)
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                 pa.array(regs, pa.binary()), *batch.columns[2:]],
                names=["doc", "n", "c", "regs", *batch.schema.names[2:]])
    return f


def _bands(s: Sketch):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = b"".join(batch.column(2).to_pylist())
            keys = band_keys(np.frombuffer(raw, np.uint16).reshape(-1, s.size), s)
            at = pa.array(np.repeat(np.arange(len(keys)), s.bands))
            yield pa.record_batch([pa.array(keys.reshape(-1)), batch.column(0).take(at), batch.column(1).take(at)],
                                  names=["key", "c", "n"])
    return f


def _plausible(s: Sketch):
    least = s.least_estimate()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, s.size)
                    for i in (2, 4))
            na, nb = (batch.column(i).to_numpy().astype(np.float64) for i in (3, 5))
            passes = pa.array(joint_estimate(a, b, na, nb, s) >= least)
            yield batch.select([0, 1]).filter(passes)
    return f


def _sets(s: Sketch):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [shingle_set(t.as_py(), s.words, memory) for t in batch.column(0).slice(at, 256)]
                yield pa.record_batch([pa.array([_identity(x) for x in found], pa.binary()),
                                       pa.array([x.tobytes() for x in found], pa.binary())], names=["c", "shingles"])
    return f


def _linked(s: Sketch):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_link(*(np.frombuffer(x.as_buffer(), np.uint64) for x in pair), s)
                    for pair in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return f


def _against_pivots(live: DataFrame, how: str, s: Sketch) -> DataFrame:
    """Distinct (a, b): members of a band and its pivot, of different components, that fit in size.

    ``central`` takes the member whose bands are fullest: of copies with edits of their own that is the original,
    which resembles each of them more than they do each other. ``hashed`` takes one by hash, another in each band.
    """
    if how == "central":
        crowd = live.groupBy("key").agg(F.count("*").alias("m"))
        score = live.join(crowd, "key").groupBy("c").agg(F.sum("m").alias("mark"))
        live = live.join(score, "c")
    else:
        live = live.withColumn("mark", F.xxhash64("key", "c"))
    pivots = live.groupBy("key").agg(F.max(F.struct(
        "mark", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))).alias("p"))
    pairs = live.join(pivots.select("key", "p.b", "p.nb", "p.rb"), "key").where("root <> rb")
    fits = 100 * F.least("n", "nb") >= s.percent * F.greatest("n", "nb")
    return pairs.where(fits).select(F.least("c", "b").alias("a"), F.greatest("c", "b").alias("b")).distinct()


def _link(a: np.ndarray, b: np.ndarray, s: Sketch) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < s.percent * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= s.percent * (len(a) + len(b) - both)


def _within_block(s: Sketch):
    """Links of different components in one block of a band; of those that close a circle only the first.

    Counts what each set shares with all others at once. Members of the most common component are not asked:
    the others are held against them.
    """
    def f(block: pa.Table) -> pa.Table:
        names = block["c"].to_pylist()
        group = np.unique(block["root"].to_pylist(), return_inverse=True)[1]
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block["shingles"]]
        # Blocks i < j hold both sides; pairs within a side are seen where i = j.
        side = block["own"].to_numpy()
        one = block["low"][0].as_py() == block["high"][0].as_py()
        n = np.array([len(x) for x in sets])
        number = np.unique(np.concatenate(sets), return_inverse=True)[1]
        member = np.repeat(np.arange(len(sets)), n)
        starts = np.concatenate([[0], np.cumsum(n)])
        held = np.zeros(number.max() + 1, bool)
        parent = list(range(group.max() + 1))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for i in np.flatnonzero(group != np.bincount(group).argmax()):
            own = number[starts[i]:starts[i + 1]]
            held[own] = True
            both = np.bincount(member[held[number]], minlength=len(sets))
            held[own] = False
            linked = 100 * both >= s.percent * (n[i] + n - both)
            for j in np.flatnonzero(linked & (group != group[i]) & (True if one else side != side[i])):
                x, y = find(int(group[i])), find(int(group[j]))
                if x != y:
                    parent[x] = y
                    out.append((names[i], names[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})
    return f


def _in_blocks(live: DataFrame, sets: DataFrame, s: Sketch, block: int = 600) -> DataFrame:
    """(a, b): links between components that still share a band, all of its members compared.

    A large band is cut into blocks by hash, and each pair of blocks is one small group, so no task holds a band
    and no pair leaves its group unless it is a link that joins two components.
    """
    crowd = live.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    placed = live.join(crowd, "key").withColumn("own", own).join(sets, "c").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = placed.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                          "own", "c", "root", "shingles")
    return pairs.groupBy("key", "low", "high").applyInArrow(_within_block(s), "a binary, b binary")


def link_classes(docs: DataFrame, classes: DataFrame, s: Sketch, text: str, key: str) -> DataFrame:
    """(node, component) over classes of equal sets that are joined by links.

    Members of a band are first held against a central pivot, then, where a band still holds several components,
    against one by hash, and only what is left after that, in blocks, against every member of another
    component that shares the band. Members already in one component are never compared again, so a large group of
    copies costs about one comparison for each, and no candidate of different components stays unseen.
    """
    banded = classes.where(F.col("n") >= s.least_size()).select("c", "n", "regs")
    entries = banded.mapInArrow(_bands(s), "key long, c binary, n long")
    shared = entries.groupBy("key").agg(F.count("*").alias("_m")).where("_m > 1").select("key")
    buckets = written(entries.join(shared, "key"), "buckets")

    needed = buckets.select("c").distinct().join(classes.select("c", "rep"), "c")
    needed = written(needed.select(F.col("rep").alias("_rep"), F.col("c").alias("_c")), "needed")
    ids = needed.select("_rep").distinct()
    if needed.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col(key).cast("long").alias("_rep"), F.col(text).alias("_t")).join(ids, "_rep", "left_semi")
    # A class of rows without an id has no smallest one: their texts are read besides, and told apart by digest below.
    unnamed = docs.where(F.col(key).cast("long").isNull()).select(F.col(text).alias("_t"))
    sets = texts.select("_t").union(unnamed).mapInArrow(_sets(s), "c binary, shingles binary")
    # Rows that repeat an id with another text give sets nobody asked for.
    sets = written(sets.join(needed.select(F.col("_c").alias("c")), "c", "left_semi").dropDuplicates(["c"]), "sets")

    links = None
    component = buckets.sparkSession.createDataFrame([], "node binary, component binary")
    regs = lambda x: classes.select(F.col("c").alias(x), F.col("regs").alias(f"r{x}"), F.col("n").alias(f"n{x}"))
    members = lambda x: sets.select(F.col("c").alias(x), F.col("shingles").alias(f"s{x}"))
    for how in ("central", "hashed", "blocks"):
        rooted = buckets.join(component, F.col("c") == F.col("node"), "left").select(
            "key", "c", "n", F.coalesce("component", "c").alias("root"))
        mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
        live = written(rooted.join(mixed.select("key"), "key", "left_semi"), "live")
        if live.isEmpty():
            break
        if how == "blocks":
            found = _in_blocks(live, sets, s)
        else:
            pairs = written(_against_pivots(live, how, s), "pairs")
            plausible = (pairs.join(regs("a"), "a").join(regs("b"), "b").select("a", "b", "ra", "na", "rb", "nb")
                         .mapInArrow(_plausible(s), "a binary, b binary"))
            found = (plausible.join(members("a"), "a").join(members("b"), "b").select("a", "b", "sa", "sb")
                     .mapInArrow(_linked(s), "a binary, b binary"))
        found = written(found, "links")
        links = found if links is None else links.union(found)
        component = connected_components(links, "a", "b")
    return component


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                    sketch: Sketch | None = None) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row; ids are bigints.

    Documents are linked if their shingle sets share at least ``percent`` of their union. The component is the
    smallest id reachable over links; the row with that id is kept. Equal sets form classes
    first, so exact copies cost one row each. Texts without a word have empty sets and are linked with
    nothing. Rows that repeat an id belong together only if their texts do. Rows without an id
    take part; their component_id is the smallest id there is, null if none, and then they are kept.

    Memory is one batch of texts and its sketches; no bucket, class or component is ever held by one task.
    """
    s = sketch or Sketch()
    signed, rooted = _grouped(docs, s, key, text)
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("c").alias("_c"), "component_id")
    joined = signed.drop("regs").join(named, F.col("c") == F.col("_c"), "left")
    of = F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component_id"))
    return joined.select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"), of.alias("component_id"),
        F.coalesce(F.col("doc") == of, of.isNull()).alias("kept"))


def _grouped(docs: DataFrame, s: Sketch, key: str, text: str, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, with the text's digest ``d`` if asked, and (c, rep, root): each class of equal sets
    with its smallest id and the class that stands for its component."""
    ship_package(docs.sparkSession)
    also = [F.unhex(F.sha2(F.col(text), 256)).alias("d")] if digest else []
    slim = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), *also)
    signed = written(slim.mapInArrow(
        _signatures(s), "doc long, n long, c binary, regs binary" + ", d binary" * digest), "sketches")
    classes = written(signed.where("n > 0").groupBy("c").agg(
        F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs")), "classes")
    component = link_classes(docs, classes, s, text, key)
    return signed, classes.join(component, F.col("c") == F.col("node"), "left").select(
        "c", "rep", F.coalesce("component", "c").alias("root"))


def keep_one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                     sketch: Sketch | None = None) -> DataFrame:
    """``docs`` with one row left of every component of near copies, whole rows, by id and text.

    Stays: the row with the smallest id, a null id last; of rows with that id and different texts, the one whose text
    has the smallest digest; of rows equal in both, the one smallest in the other columns. Rows that repeat an id
    are told apart by their texts, so none goes because another row with its id does. Texts without a word are
    copies of nothing and stay, null or empty, repeated or not. An empty table stays empty.
    """
    signed, rooted = _grouped(docs, sketch or Sketch(), key, text, True)
    places = signed.where("n > 0").groupBy("doc", "d", "c").agg(F.count("*").alias("m")).join(
        rooted.select("c", "root"), "c")
    place = F.struct(F.col("doc").isNull().alias("unnamed"), F.col("doc").alias("doc"), F.col("d").alias("d"))
    best = places.groupBy("root").agg(F.min(place).alias("best"))
    # One row a place: whether its rows go, or are several of which one stays. Places of a single kept row need none.
    judged = places.join(best, "root").withColumn("stays", place.eqNullSafe(F.col("best"))).where("not stays or m > 1")
    judged = written(judged.select(
        F.col("doc").alias("_doc"), F.col("d").alias("_of"), F.col("stays").alias("_stays")), "judged")
    # A few rows are sent to every task; with more, rows are shuffled by id and digest.
    if judged.count() <= BROADCAST_ROWS:
        judged = F.broadcast(judged)
    keyed = docs.withColumn("_d", F.unhex(F.sha2(F.col(text), 256)))
    same = keyed[key].cast("long").eqNullSafe(F.col("_doc")) & (F.col("_d") == F.col("_of"))
    several = keyed.join(judged.where("_stays"), same).groupBy(key, "_d").agg(
        F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("_row"))
    return keyed.join(judged, same, "left_anti").select(*docs.columns).union(several.select("_row.*"))
