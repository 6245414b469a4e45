"""Word vectors trained with negative sampling, skip-gram or CBOW, without the vocabulary on the driver.

Words are dealt to blocks by hash. A task holds the input vectors of one block and the output vectors of another, and
is fed the training examples that need just these two: in a round every block of inputs meets another block of outputs,
and after as many rounds as there are blocks all pairs have met. So tasks never share a vector, need no locks, and
a rerun gives the same vectors. Between rounds the blocks are written to the folder all executors share.

Noise words are drawn from an alias table of count ** 0.75 over the block of outputs at hand; blocks being hashes, each
is a like sample of the vocabulary. In CBOW the mean of a word's context is taken over the context words of one
block at a time, over all of them if there is one block.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.config import EmbeddingConfig
from lexiloom.operators import shaping
from lexiloom.operators.vocabulary import BROADCAST_TERMS
from lexiloom.session import cut_lineage, shared_dir
from lexiloom.sources import readers, writers


@dataclasses.dataclass(frozen=True)
class Training:
    """``words_per_block`` bounds the two matrices of a task. ``sample`` is the share of the corpus above which frequent
    words are thinned out, None for not at all. Updates are summed over ``batch`` examples."""

    negative: int = 5
    words_per_block: int = 50_000
    least_blocks: int = 1
    sample: float | None = 1e-3
    start_rate: float = 0.025
    end_rate: float = 0.0001
    batch: int = 256
    power: float = 0.75


def alias_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keep, other): slot i stands for itself with probability keep[i], else for other[i]; slots are drawn evenly."""
    n = len(weights)
    keep, other = weights * (n / weights.sum()), np.arange(n)
    small, large = [i for i in range(n) if keep[i] < 1], [i for i in range(n) if keep[i] >= 1]
    while small and large:
        i, j = small.pop(), large.pop()
        other[i] = j
        keep[j] -= 1 - keep[i]
        (small if keep[j] < 1 else large).append(j)
    return np.minimum(keep, 1.0), other


def draw(table: tuple[np.ndarray, np.ndarray], size, rng: np.random.Generator) -> np.ndarray:
    slot = rng.integers(len(table[0]), size=size)
    return np.where(rng.random(size) < table[0][slot], slot, table[1][slot])


def train_batch(inputs: np.ndarray, outputs: np.ndarray, ins: np.ndarray, lens: np.ndarray, outs: np.ndarray,
                noise: np.ndarray, rate: float) -> None:
    """One step on examples (the mean of ``lens`` inputs each, one output, its noise words), in place."""
    begin = np.cumsum(lens) - lens
    hidden = np.add.reduceat(inputs[ins], begin, axis=0) / lens[:, None]
    words = np.concatenate([outs[:, None], noise], axis=1)
    truth = np.zeros(words.shape)
    truth[:, 0] = 1.0
    rows = outputs[words]
    score = np.einsum("bd,bkd->bk", hidden, rows)
    step = rate * (truth - 1.0 / (1.0 + np.exp(-np.clip(score, -30, 30))))
    step[:, 1:][noise == outs[:, None]] = 0.0  # the word itself is no noise
    back = np.einsum("bk,bkd->bd", step, rows)
    np.add.at(outputs, words.reshape(-1), (step[:, :, None] * hidden[:, None, :]).reshape(-1, hidden.shape[1]))
    np.add.at(inputs, ins, np.repeat(back, lens, axis=0))


def vocabulary(corpus: DataFrame, cfg: EmbeddingConfig, t: Training) -> DataFrame:
    """(word, count, block, place): words of ``min_count`` or more; ``place`` numbers a block's words by count."""
    counts = cut_lineage(corpus.select(F.explode("tokens").alias("word")).groupBy("word").agg(
        F.count("*").alias("count")).filter(F.col("count") >= cfg.min_count))
    blocks = max(t.least_blocks, -(-counts.count() // t.words_per_block))
    dealt = counts.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int"))
    order = W.partitionBy("block").orderBy(F.desc("count"), "word")
    return cut_lineage(dealt.withColumn("place", (F.row_number().over(order) - 1).cast("int")))


def _encoded(corpus: DataFrame, words: DataFrame, cfg: EmbeddingConfig, t: Training) -> DataFrame:
    """(doc, blocks, places): the known words of every text in order, frequent ones thinned out by hash."""
    total, size = words.agg(F.sum("count"), F.count("*")).first()
    keep = F.lit(1.0)
    if t.sample is not None:
        share = F.col("count") / F.lit(float(total or 1))
        keep = F.least(F.lit(1.0), F.sqrt(F.lit(t.sample) / share) + F.lit(t.sample) / share)
    known = words.select("word", "block", "place", keep.alias("keep"))
    known = F.broadcast(known) if size <= BROADCAST_TERMS else known
    said = corpus.select("doc", F.posexplode("tokens").alias("at", "word"))
    unit = F.pmod(F.xxhash64("doc", "at", F.lit(cfg.seed)), F.lit(1 << 30)) / float(1 << 30)
    kept = said.join(known, "word").filter(unit < F.col("keep"))
    row = F.sort_array(F.collect_list(F.struct("at", "block", "place")))
    return kept.groupBy("doc").agg(row.alias("w")).select(
        "doc", F.transform("w", lambda x: x["block"]).alias("blocks"), F.transform("w", lambda x: x["place"]).alias("places"))


def _examples(cfg: EmbeddingConfig, blocks: int, epoch: int):
    """Encoded texts to rows (r, i, j, doc, ins, lens, outs): a text's examples for inputs of block i, outputs of j."""
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, owner, place in zip(*(batch.column(i) for i in range(3))):
                b, p = np.array(owner.as_py(), np.int64), np.array(place.as_py(), np.int32)
                n, key = len(b), doc.as_py()
                reach = np.random.default_rng([cfg.seed, epoch, key & 0xFFFFFFFFFFFFFFFF]).integers(1, cfg.window + 1, size=n)
                centre, near = [], []
                for step in range(1, min(cfg.window, n - 1) + 1):
                    at = np.arange(n - step)
                    for c, x in ((at, at + step), (at + step, at)):
                        far = reach[c] >= step
                        centre.append(c[far]), near.append(x[far])
                if not centre:
                    continue
                centre, near = np.concatenate(centre), np.concatenate(near)
                order = np.lexsort((near, centre, b[near], b[centre]))
                centre, near = centre[order], near[order]
                group = b[near] * blocks + b[centre]
                cuts = np.flatnonzero(np.diff(group)) + 1
                for c, x in zip(np.split(centre, cuts), np.split(near, cuts)):
                    if cfg.is_skip_gram:
                        lens, outs = np.ones(len(c), np.int32), p[c]
                    else:
                        first = np.flatnonzero(np.append(True, np.diff(c) != 0))
                        lens, outs = np.diff(np.append(first, len(c))).astype(np.int32), p[c[first]]
                    i, j = int(b[x[0]]), int(b[c[0]])
                    out.append(((j - i) % blocks, i, j, key, p[x].tobytes(), lens.tobytes(), outs.tobytes()))
            if out:
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["r", "i", "j", "doc", "ins", "lens", "outs"])
    return f


def _matrices(cfg: EmbeddingConfig):
    """(block, counts) to the first matrices (side, block, counts, matrix): small random inputs, outputs of zeros."""
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rng = np.random.default_rng([cfg.seed, block])
                first = (rng.random((len(counts), cfg.vector_size)) - 0.5) / cfg.vector_size
                body = np.array(counts, np.float64).tobytes()
                yield pa.record_batch(
                    [pa.array(["in", "out"]), pa.array([block] * 2, pa.int32()), pa.array([body] * 2, pa.binary()),
                     pa.array([first.tobytes(), np.zeros_like(first).tobytes()], pa.binary())], names=["side", "block", "counts", "matrix"])
    return f


def _round(cfg: EmbeddingConfig, t: Training, epoch: int, r: int, rate: tuple[float, float]):
    """Rows of a task (task, kind, doc, block, counts, matrix, ins, lens, outs) in order: its two matrices, then examples."""
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, waiting, table, rng, seen = None, {}, [[], [], []], None, None, 0

        def step() -> None:
            nonlocal seen
            if not waiting[1]:
                return
            ins, lens, outs = (np.concatenate(x) for x in waiting)
            ends = np.cumsum(lens)
            for at in range(0, len(lens), t.batch):
                some = slice(at, at + t.batch)
                begin = ends[at] - lens[at]
                # The learning rate falls over the round by what the task has seen; the total is not known to it.
                now = max(rate[1], rate[0] - (rate[0] - rate[1]) * min(1.0, seen / 1e6))
                noise = draw(table, (len(lens[some]), t.negative), rng)
                train_batch(held["in"][2], held["out"][2], ins[begin:ends[min(at + t.batch, len(lens)) - 1]], lens[some], outs[some], noise, now)
                seen += len(lens[some])
            for x in waiting:
                x.clear()

        def done() -> pa.RecordBatch:
            step()
            rows = [(side, block, counts, m.tobytes()) for side, (block, counts, m) in held.items()]
            kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["side", "block", "counts", "matrix"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != task:
                    if held:
                        yield done()
                    task, held, seen = row[0], {}, 0
                    rng = np.random.default_rng([cfg.seed, epoch, r, task])
                if row[5] is not None:
                    m = np.frombuffer(row[5]).reshape(-1, cfg.vector_size).copy()
                    held[row[1]] = (row[3], row[4], m)
                    if row[1] == "out":
                        table = alias_table(np.frombuffer(row[4]) ** t.power)
                else:
                    for into, x in zip(waiting, row[6:9]):
                        into.append(np.frombuffer(x, np.int32))
                    if sum(map(len, waiting[1])) >= 64 * t.batch:
                        step()
        if held:
            yield done()
    return f


def fit(train: DataFrame, cfg: EmbeddingConfig, training: Training = Training(), key: str = "row_id") -> DataFrame:
    """(word, vector): the input vectors of all words of ``min_count`` or more in the tokens of ``train``.

    ``cfg`` gives the architecture, window, sizes, epochs and seed, as for the other form. Texts without two known
    words train nothing. Equal texts count as often as they stand there; null keys and repeated ones are fine, they
    only share random draws. An empty corpus gives no words. The vectors depend on ``training`` and the seed, not on
    the layout of the table.
    """
    t, spark = training, train.sparkSession
    corpus = shaping.tokenized(train, cfg.text_column, cfg.min_review_tokens, cfg.max_review_tokens)
    corpus = corpus.select(F.xxhash64(key, "tokens").alias("doc"), "tokens")
    words = vocabulary(corpus, cfg, t)
    highest = words.agg(F.max("block")).first()[0]
    if highest is None:
        return words.select("word", F.array().cast("array<double>").alias("vector"))
    blocks = max(highest + 1, t.least_blocks)
    out = shared_dir(spark, "negative-sampling")
    encoded = cut_lineage(_encoded(corpus, words, cfg, t))
    counted = words.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "count"))).alias("c")).select(
        "block", F.transform("c", lambda x: x["count"]).alias("counts"))
    state = "side string, block int, counts binary, matrix binary"
    writers.write_table(counted.mapInArrow(_matrices(cfg), state), f"{out}/start")
    matrices = readers.read_table(spark, f"{out}/start")
    fall = (t.start_rate - t.end_rate) / max(1, cfg.epochs * blocks)
    for epoch in range(cfg.epochs):
        writers.write_table(encoded.mapInArrow(
            _examples(cfg, blocks, epoch), "r int, i int, j int, doc long, ins binary, lens binary, outs binary"), f"{out}/examples-{epoch}", "r")
        examples = spark.read.schema("i int, j int, doc long, ins binary, lens binary, outs binary, r int").parquet(f"{out}/examples-{epoch}")
        for r in range(blocks):
            begin = t.start_rate - fall * (epoch * blocks + r)
            # Inputs of block i are with task i, outputs of block j with the task whose turn they are.
            task = F.when(F.col("side") == "in", F.col("block")).otherwise(F.pmod(F.col("block") - r, F.lit(blocks)))
            none = F.lit(None).cast("binary")
            given = matrices.select(task.cast("int").alias("task"), F.col("side").alias("kind"), F.lit(0).cast("long").alias("doc"),
                                    "block", "counts", "matrix", none.alias("ins"), none.alias("lens"), none.alias("outs"))
            fed = examples.filter(F.col("r") == r).select(
                F.col("i").alias("task"), F.lit("text").alias("kind"), "doc", F.col("j").alias("block"), none.alias("counts"), none.alias("matrix"),
                "ins", "lens", "outs")
            rows = given.unionByName(fed).repartition(blocks, "task").sortWithinPartitions("task", F.col("kind") == "text", "kind", "doc", "ins", "outs")
            writers.write_table(rows.mapInArrow(_round(cfg, t, epoch, r, (begin, begin - fall)), state), f"{out}/{epoch}-{r}")
            matrices = readers.read_table(spark, f"{out}/{epoch}-{r}")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, matrix in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = np.frombuffer(matrix).reshape(-1, cfg.vector_size)
                yield pa.record_batch([pa.array([block] * len(m), pa.int32()), pa.array(np.arange(len(m), dtype=np.int32)),
                                       pa.array(list(m), pa.list_(pa.float64()))], names=["block", "place", "vector"])

    vectors = matrices.filter("side = 'in'").select("block", "matrix").mapInArrow(unpack, "block int, place int, vector array<double>")
    return words.join(vectors, ["block", "place"]).select("word", "vector")
