"""The trie of all conversation prefixes, as a table of nodes with sums over their subtrees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexiloom.llm.common import written
from lexiloom.session import ship_package

WIDTH = 1 << 14  # conversations below the nodes of one shard, for each node of the shards under it
BATCH = 1 << 16  # node rows of whole shards that share one table
CHUNK = 10_000  # ids joined at once
ROOT = hashlib.blake2b(digest_size=16).digest()


def _prefixes(key_type: pa.DataType):
    """Sorted rows (id, turn, role, text) to one row a prefix; the digest of a prefix runs over all its turns."""
    names = ["conv_id", "depth", "digest", "parent", "chars", "ends"]
    kinds = [key_type, pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, depth, running, digest, held = object(), 0, None, ROOT, None
        for batch in batches:
            out = []
            for key, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if key != who:
                    if held:
                        out.append((*held, True))
                    who, depth, running, digest = key, 0, hashlib.blake2b(digest_size=16), ROOT
                elif held:
                    out.append((*held, False))
                role, text = (role or "").encode("utf-8", "surrogatepass"), text or ""
                body = text.encode("utf-8", "surrogatepass")
                running.update(b"%d %d " % (len(role), len(body)) + role + body)
                parent, digest, depth = digest, running.digest(), depth + 1
                held = (key, depth, digest, parent, len(text))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        if held:
            yield pa.record_batch([pa.array([c], k) for c, k in zip((*held, True), kinds)], names=names)
    return f


class NodeTable:
    """Distinct digests and a minimal perfect hash that gives each one a slot of its own, 0 to n - 1.

    Each level hashes what is left into twice as many places; digests alone in their place are settled, their slot
    is the rank of the place. Every slot keeps its digest, so that a lookup is verified: a digest not in the table,
    or one that collides, gets -1.
    """

    def __init__(self, digests: np.ndarray):
        rest = np.unique(digests, axis=0)
        self.levels: list[tuple[int, np.ndarray]] = []
        self.stored = np.empty_like(rest)
        settled = 0
        while len(rest):
            size = 2 * len(rest)
            place = self._place(rest, size, len(self.levels))
            alone = np.bincount(place, minlength=size)[place] == 1
            slots = np.full(size, -1)
            taken = np.sort(place[alone])
            slots[taken] = settled + np.arange(len(taken))
            self.stored[slots[place[alone]]] = rest[alone]
            self.levels.append((size, slots))
            settled, rest = settled + len(taken), rest[~alone]

    @staticmethod
    def _place(digests: np.ndarray, size: int, level: int) -> np.ndarray:
        h = (digests[:, 0] + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) ^ (digests[:, 1] >> np.uint64(level % 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.stored)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        out = np.full(len(digests), -1)
        open_ = np.arange(len(digests))
        for level, (size, slots) in enumerate(self.levels):
            found = slots[self._place(digests[open_], size, level)]
            hit = found >= 0
            out[open_[hit]] = found[hit]
            open_ = open_[~hit]
        known = out >= 0
        out[known] = np.where((self.stored[out[known]] == digests[known]).all(axis=1), out[known], -1)
        return out


def accumulate(digest: np.ndarray, parent: np.ndarray, depth: np.ndarray, own: np.ndarray, children: np.ndarray,
               leaves: np.ndarray, saved: np.ndarray) -> tuple[NodeTable, np.ndarray, np.ndarray, np.ndarray]:
    """(table, children, leaves, saved by slot) of the subtrees of some shards.

    Rows with a depth are nodes: ``own`` is what the node itself saves. Rows with depth -1 add to a node what hangs
    below it in other shards. A parent that is not in the table is in another shard.
    """
    is_node = depth >= 0
    table = NodeTable(digest[is_node])
    slot = table.slots(digest)
    if len(table) != is_node.sum() or (slot < 0).any():
        raise ValueError("two prefixes share a digest, or a subtree's node is missing")
    counts = [np.zeros(len(table), np.int64) for _ in range(3)]
    for into, values in zip(counts, (children, leaves, saved + own)):
        np.add.at(into, slot, values)
    n_children, n_leaves, n_saved = counts
    above, level = np.full(len(table), -1), np.zeros(len(table), np.int64)
    above[slot[is_node]] = table.slots(parent[is_node])
    level[slot[is_node]] = depth[is_node]
    np.add.at(n_children, above[above >= 0], 1)
    n_leaves[n_children == 0] = 1
    # Deepest first: what a node passes on is whole by then.
    order = np.argsort(-level, kind="stable")
    for lot in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
        inner = lot[above[lot] >= 0]
        np.add.at(n_leaves, above[inner], n_leaves[inner])
        np.add.at(n_saved, above[inner], n_saved[inner])
    return table, n_children, n_leaves, n_saved


def _pairs(column: pa.Array) -> np.ndarray:
    """16-byte digests as two numbers each; nulls as zeros."""
    return np.frombuffer(b"".join(x or bytes(16) for x in column.to_pylist()), "<u8").reshape(-1, 2)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard (shard, digest, parent, depth, own, n_children, n_leaves, saved) to sums a node."""
    def settle(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        column = lambda n: rows.column(n).chunk(0)
        numbers = [column(n).to_numpy() for n in ("depth", "own", "n_children", "n_leaves", "saved")]
        table, *sums = accumulate(_pairs(column("digest")), _pairs(column("parent")), *numbers)
        body = table.stored.tobytes()
        return pa.record_batch([pa.array([body[i:i + 16] for i in range(0, len(body), 16)], pa.binary()),
                                *(pa.array(s) for s in sums)], names=["digest", "n_children", "n_leaves", "saved"])

    held, size, shard = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_pylist()
        begin = 0
        for i, key in enumerate(keys):
            if key != shard:
                if size + i - begin > BATCH:
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    yield settle(pa.Table.from_batches(held))
                    held, size, begin = [], 0, i
                shard = key
        held.append(batch.slice(begin))
        size += batch.num_rows - begin
    if held:
        yield settle(pa.Table.from_batches(held))


def _joined_ids(key_type: pa.DataType):
    """Sorted (digest, conv_id) to chunks: the ids of one digest, comma-joined, with the first of them."""
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunk():
            return pa.record_batch([pa.array([at], pa.binary()), pa.array([ids[0]], key_type),
                                    pa.array([",".join(map(str, ids))])], names=["digest", "first", "ids"])

        at, ids = None, []
        for batch in batches:
            done = []
            for digest, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (digest != at or len(ids) >= CHUNK):
                    done.append(chunk())
                    ids = []
                at = digest
                ids.append(key)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if ids:
            yield chunk()
    return f


def _ends_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks (digest, first, ids) to one running hash a digest."""
    at, running = None, None
    for batch in batches:
        done = []
        for digest, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if digest != at:
                if running:
                    done.append((at, running.hexdigest()))
                at, running = digest, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        if done:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done), (pa.binary(), pa.string()))], names=["digest", "ends_sha256"])
    if running:
        yield pa.record_batch([pa.array([at], pa.binary()), pa.array([running.hexdigest()])], names=["digest", "ends_sha256"])


def prefix_trie(rows: DataFrame, conversations: DataFrame | None = None, *, key: str = "conv_id", turn: str = "turn",
                role: str = "role", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per distinct prefix: ``digest`` (hex), conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves (childless nodes below, or the node itself), saved_tokens (code points that a cache of the
    subtree's prefixes saves: each node's members but one, times its last text) and ends_sha256 (of its members that
    end there, ascending and comma-joined).

    ``conversations`` may list further ids under ``key`` that have no rows: members of the root alone.
    A conversation's turns are hashed in order, streamed through one task; only digests travel from there on.
    Members are counted with partial sums. For subtree sums, nodes are dealt to shards: a shard holds a subtree of
    up to ``width`` conversations; the nodes above these that stand over up to width ** 2 form shards of their own,
    and so on, up to the root. In each shard a minimal perfect hash assigns a slot to every digest, counts are
    scattered into flat arrays and summed through the parents' slots, deepest first; a shard's top node then hands
    its sums to its parent's shard. No shard holds more than width paths, however hot a first turn is.
    Ids are joined in chunks by many tasks; a node's chunks meet in one, which only hashes them.

    Turns are ordered by turn, null first, then role and text; repeated rows are turns. Null roles and texts
    are empty. Rows without a conversation id belong to no conversation and are left out. An empty table has no
    root and gives an empty result. Further columns are ignored, whatever their names.
    """
    ship_package(rows.sparkSession)
    field = rows.schema[key]
    kind, arrow_kind = field.dataType.simpleString(), to_arrow_type(field.dataType)
    slim = rows.where(F.col(key).isNotNull()).select(
        F.col(key).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    deep = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(
        _prefixes(arrow_kind), f"conv_id {kind}, depth long, digest binary, parent binary, chars long, ends boolean")
    members = slim.select("conv_id", F.lit(True).alias("has"))
    if conversations is not None:
        members = members.union(conversations.where(F.col(key).isNotNull()).select(F.col(key).cast(kind), F.lit(False)))
    tops = members.groupBy("conv_id").agg(F.max("has").alias("has")).select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("chars"), (~F.col("has")).alias("ends"))
    prefixes = written(deep.unionByName(tops), "prefixes")

    nodes = written(prefixes.groupBy("digest").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"),
        F.max("depth").alias("_depth"), F.min("parent").alias("parent"), F.max("parent").alias("_parent"),
        F.min("chars").alias("chars"), F.max("chars").alias("_chars")).select(
            "digest", "conv_id", "n_convs", "parent", "chars", F.when(
                (F.col("depth") == F.col("_depth")) & F.col("parent").eqNullSafe(F.col("_parent")) & (F.col("chars") == F.col("_chars")),
                F.col("depth")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("long")).alias("depth")), "nodes")
    total = nodes.agg(F.max("n_convs")).first()[0] or 0
    bounds = [width]
    while bounds[-1] < total:
        bounds.append(bounds[-1] * width)

    def level(n: str):
        return 1 + sum((F.col(n) > b).cast("int") for b in bounds)

    paths = prefixes.select("conv_id", "depth", "digest").join(nodes.select("digest", "n_convs"), "digest").groupBy("conv_id").agg(
        *(F.min(F.when(F.col("n_convs") <= b, F.struct("depth", "digest"))).alias(f"_r{i}") for i, b in enumerate(bounds)))
    shards = paths.select("conv_id", F.array(*(F.col(f"_r{i}.digest") for i in range(len(bounds)))).alias("shards"))
    parents = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("_n"))
    placed = written(nodes.join(shards, "conv_id").join(parents, "parent", "left").withColumn("level", level("n_convs")).withColumn(
        "parent_level", F.when(F.col("_n").isNotNull(), level("_n"))), "placed-nodes")
    zero = F.lit(0).cast("long")
    sums, handed = None, None
    for i in range(1, len(bounds) + 1):
        own = placed.where(F.col("level") == i).select(
            F.element_at("shards", i).alias("shard"), "digest", "parent", "depth",
            ((F.col("n_convs") - 1) * F.col("chars")).alias("own"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved"))
        if handed is not None:
            own = own.unionByName(handed.where(F.col("level") == i).drop("level"))
        done = written(own.repartition("shard").sortWithinPartitions("shard").mapInArrow(
            _subtrees, "digest binary, n_children long, n_leaves long, saved long"), "subtree-sums")
        sums = done if sums is None else sums.unionByName(done)
        # A shard's top node hands on what its subtree holds, to the shard of its parent.
        above = placed.where(F.col("level") == i).where(F.element_at("shards", i) == F.col("digest")).where("parent is not null").select(
            "digest", F.col("parent").alias("_parent"), F.col("parent_level").alias("level"),
            F.element_at("shards", F.col("parent_level")).alias("shard"))
        gift = above.join(done, "digest").select(
            "level", "shard", F.col("_parent").alias("digest"), F.lit(None).cast("binary").alias("parent"),
            F.lit(-1).cast("long").alias("depth"), zero.alias("own"), F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved")
        gift = gift.groupBy("level", "shard", "digest", "parent", "depth", "own").agg(
            *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")))
        handed = gift if handed is None else handed.unionByName(gift)
    ending = prefixes.where("ends").select("digest", "conv_id")
    chunks = ending.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(
        _joined_ids(arrow_kind), f"digest binary, first {kind}, ids string")
    ends = chunks.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(
        _ends_hashed, "digest binary, ends_sha256 string")
    return placed.drop("shards", "level", "parent_level", "_n").join(sums, "digest").join(ends, "digest", "left").select(
        F.hex("digest").alias("digest"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
