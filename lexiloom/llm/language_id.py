"""Language identification: sparse multinomial logistic regression on hashed character n-grams."""

from __future__ import annotations

import dataclasses
import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.session import ship_package

UNDETERMINED = "und"
PIECE = 1 << 20  # characters turned into n-grams at a time


@dataclasses.dataclass(frozen=True)
class Settings:
    """bits: n-grams are hashed into 2**bits buckets. per_label bounds the fitting sample: at most that many
    rows of each label. All labels are learned: fitting takes 2**bits * 16 bytes a label in one task, so
    thousands of labels want fewer bits. Of the longest n-grams, hashed into 2**wide buckets, those in at least one
    of ``rare`` documents are familiar."""

    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    per_label: int = 1000
    wide: int = 18
    rare: int = 1000
    epochs: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.01
    scale: float = 100.0


@dataclasses.dataclass
class Model:
    """table[b] holds idf * weight of bucket b for every label; logits are divided by temperature.
    familiar[b] says whether the longest n-grams of wide bucket b are; of a label's texts, more than the share
    least_familiar is."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    settings: Settings
    familiar: np.ndarray
    least_familiar: np.ndarray
    non_zero: int = 0

    def judge(self, text: str) -> tuple[np.ndarray, float] | None:
        """Logits and the share of familiar n-grams; None if the text has no letter."""
        total, count, known, longest = np.zeros(len(self.labels)), 0, 0, 0
        for ids, wide in bucket_pieces(text, self.settings):
            total += self.table[ids].sum(axis=0, dtype=np.float64)
            count += len(ids)
            known += int(np.count_nonzero(self.familiar[wide]))
            longest += len(wide)
        return (self.bias + self.settings.scale * total / count, known / max(longest, 1)) if count else None


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def bucket_pieces(text: str, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams, and wide buckets of the longest, in pieces: letters lower-cased, anything else one space.

    A piece goes on where the one before it ended, so n-grams over a seam are the text's own.
    """
    carry, was_letter, spoken = np.full(1, 32, np.uint32), False, False
    for at in range(0, len(text), PIECE):
        raw = text[at:at + PIECE].lower().encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(raw, "<u4")
        letter = _letters()[points]
        last = at + PIECE >= len(text)
        spoken = spoken or bool(letter.any())
        if not spoken:
            continue
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= was_letter
        fresh = np.where(letter, points, 32)[keep].astype(np.uint32)
        chars = np.concatenate([carry, fresh, np.full(int(last), 32, np.uint32)])
        out, wide = [], np.zeros(0, np.int64)
        for n in s.orders:
            first = max(0, len(carry) - n + 1)
            size = len(chars) - n + 1 - first
            if size <= 0:
                continue
            h = np.full(size, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
            for j in range(n):
                h = h * np.uint32(0x01000193) ^ chars[first + j:first + j + size]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0x297A2D39)
            if n == s.orders[-1]:
                wide = h >> np.uint32(32 - s.wide)
            if n == 1:
                h = h[chars[first:first + size] != 32]
            out.append(h >> np.uint32(32 - s.bits))
        if out:
            yield np.concatenate(out), wide
        carry, was_letter = chars[max(0, len(chars) - max(s.orders) + 1):], bool(letter[-1])


def _document_frequencies(s: Settings):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Wide buckets are numbered behind the others.
        size = (1 << s.bits) + (1 << s.wide)
        total, mark, n = np.zeros(size, np.int64), np.zeros(size, bool), 0
        for batch in batches:
            for text in batch.column(0):
                mark[:] = False
                for ids, wide in bucket_pieces(text.as_py() or "", s):
                    mark[ids] = True
                    mark[(1 << s.bits) + wide.astype(np.int64)] = True
                total += mark
                n += 1
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))],
                              names=["bucket", "df"])
    return f


def _train(s: Settings, labels: list[str], idf: np.ndarray, familiar: np.ndarray):
    """Fits on the sampled rows (one bounded partition) and yields the pickled model."""
    def features(text: str) -> tuple[np.ndarray, np.ndarray, float] | None:
        pieces = [*bucket_pieces(text, s)]
        if not sum(len(ids) for ids, _ in pieces):
            return None
        ids, counts = np.unique(np.concatenate([ids for ids, _ in pieces]), return_counts=True)
        wide = np.concatenate([wide for _, wide in pieces])
        return ids, s.scale * counts / counts.sum() * idf[ids], familiar[wide].mean() if len(wide) else 1.0

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for h, label, text in zip(*[batch.column(c).to_pylist() for c in ("_h", "_label", "_text")]):
                if (x := features(text or "")) is not None:
                    rows.append((h, labels.index(label), *x))
        rows.sort(key=lambda r: r[0])
        held = [r for i, r in enumerate(rows) if i % 5 == 4]
        fit = [r for i, r in enumerate(rows) if i % 5 != 4]
        k, b = len(labels), 1 << s.bits
        z, n = np.zeros((b, k)), np.zeros((b, k))
        zb, nb, eye = np.zeros(k), np.zeros(k), np.eye(k)

        def weights(z, n, l1):
            w = -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)
            return np.where(np.abs(z) > l1, w, 0.0)

        def step(z, n, w, g):
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / s.alpha * w
            n += g * g
            return z, n

        for _ in range(s.epochs):
            for _, y, ids, x, _ in fit:
                w, wb = weights(z[ids], n[ids], s.l1), weights(zb, nb, 0.0)
                p = _softmax(x @ w + wb)
                z[ids], n[ids] = step(z[ids], n[ids], w, x[:, None] * (p - eye[y]))
                zb, nb = step(zb, nb, wb, p - eye[y])
        w, wb = weights(z, n, s.l1), weights(zb, nb, 0.0)
        scores = np.array([x @ w[ids] + wb for _, _, ids, x, _ in held]).reshape(-1, k)
        truth = np.array([r[1] for r in held], int)
        # Half of what nearly all texts of a label have: garbled and foreign ones have far less.
        shares = [[r[4] for r in rows if r[1] == i] for i in range(k)]
        least = np.array([np.quantile(x, 0.01) / 2 if x else 0.0 for x in shares])
        model = Model(labels, (idf[:, None] * w).astype(np.float32), wb, _temperature(scores, truth), s,
                      familiar, least, int((w != 0).sum()))
        yield pa.record_batch([pa.array([pickle.dumps(model)])], names=["model"])
    return f


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on held-back rows; 1 without any."""
    if not len(truth):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.1), np.log(20), 200))
    loss = [-np.log(_softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_languages(docs: DataFrame, *, where: Column | None = None, key: str = "doc_id",
                  text: str = "text", label: str = "lang", settings: Settings | None = None) -> Model | None:
    """Learns from rows with a label (and ``where``); None if there is none.

    Document frequencies are counted over all these rows, in one row per bucket and task. Weights are
    fitted on a bounded sample: of each label the ``per_label`` rows with the smallest key hash, in
    one task. Follow-the-regularised-leader steps with elastic net keep most weights at zero; every
    fifth sampled row is held back for the temperature.
    """
    s = settings or Settings()
    ship_package(docs.sparkSession)
    rows = docs.where(F.col(label).isNotNull() if where is None else where & F.col(label).isNotNull())
    per_label = sorted((r[0], r[1]) for r in rows.groupBy(F.col(label).cast("string")).count().collect())
    if not per_label:
        return None
    counts = {r[0]: r[1] for r in rows.select(F.col(text).alias("_text")).mapInArrow(
        _document_frequencies(s), "bucket long, df long").groupBy("bucket").sum("df").collect()}
    total = counts.pop(-1)
    df = np.zeros((1 << s.bits) + (1 << s.wide))
    df[np.fromiter(counts, np.int64, len(counts))] = np.fromiter(counts.values(), np.int64, len(counts))
    df, seen = df[:1 << s.bits], df[1 << s.bits:]
    idf = np.log((1 + total) / (1 + df)) + 1
    familiar = seen >= max(1, total // s.rare)

    # Twice the rows that are wanted pass the scan; the rest is cut exactly after a small shuffle.
    h = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    unit = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    bound = F.lit(0.0)
    for name, n in per_label:
        bound = F.when(F.col(label).cast("string") == name, min(1.0, (2 * s.per_label + 50) / n)).otherwise(bound)
    some = rows.where(unit < bound).select(
        h.alias("_h"), F.col(label).cast("string").alias("_label"), F.col(text).alias("_text"))
    rank = F.row_number().over(W.partitionBy("_label").orderBy("_h", F.xxhash64("_text")))
    sample = some.withColumn("_r", rank).where(F.col("_r") <= s.per_label).drop("_r")
    fitted = sample.repartition(1).mapInArrow(
        _train(s, [name for name, _ in per_label], idf, familiar), "model binary").collect()
    return pickle.loads(bytes(fitted[0][0]))


def predict_languages(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (the calibrated probability of that language), familiar (the share of the text's longest
    n-grams that labelled texts commonly hold) and known: whether that is enough for a text of that language.

    Every n-gram of the whole text counts. Of languages equally likely the first in order is taken. Null texts and texts
    without a letter are ``und`` with score 0 and not known, as is everything without a model. The model is
    bounded by buckets times labels and sent once to each executor; nothing is shuffled. Columns with the
    four names are replaced.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "familiar", "known", "_p")]
    if model is None:
        return docs.select(*own, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(0.0).alias("familiar"), F.lit(False).alias("known"))
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: pd.Series) -> pd.DataFrame:
        m, out = sent.value, []
        for t in texts:
            judged = m.judge(t) if t else None
            if judged is None:
                out.append((UNDETERMINED, 0.0, 0.0, False))
            else:
                p = _softmax(judged[0] / m.temperature)
                best = int(p.argmax())
                out.append((m.labels[best], float(p[best]), judged[1], bool(judged[1] >= m.least_familiar[best])))
        return pd.DataFrame(out, columns=["lang_pred", "score", "familiar", "known"])

    udf = F.pandas_udf(judge, "lang_pred string, score double, familiar double, known boolean")
    return docs.select(*own, udf(F.col(text)).alias("_p")).select(*own, "_p.*")
