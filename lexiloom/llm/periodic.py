"""Runs of periodic words in a text: stretches that repeat one and the same sequence of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexiloom.session import ship_package

Run = tuple[int, int, int]  # start, length, period, in words
SHORT_LAGS = 16  # lags up to this are compared at every word; longer ones at probes, by hashes of eight words


def _neighbours(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every word, the places of its occurrences before (-1: none) and after (n: none)."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    before, after = np.full(n, -1), np.full(n, n)
    same = words[order][1:] == words[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def surviving_segments(words: np.ndarray, least: int, ends: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Segments [start, end) that may hold a run, by splitting at words that are too rare where they stand.

    A run holds its period twice at least, so each of its words stands in it twice. A word that stands once within
    its segment is in no run of it and splits it; the parts are judged anew until none splits. Segments of fewer
    than ``least`` words hold none. ``ends`` (ascending, the last is the number of words) splits beforehand.
    """
    before, after = _neighbours(words)
    ends = np.array([len(words)]) if ends is None else ends
    starts = np.append(0, ends[:-1])
    done: list[tuple[int, int]] = []
    while True:
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return done
        size = ends - starts
        segment = np.repeat(np.arange(len(starts)), size)
        at = np.arange(len(segment)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
        rare = (before[at] < starts[segment]) & (after[at] >= ends[segment])
        splits = np.bincount(segment[rare], minlength=len(starts)) > 0
        done += zip(starts[~splits].tolist(), ends[~splits].tolist())
        # The parts of a split segment lie between its rare words.
        cut = at[rare]
        starts, ends = (np.sort(np.concatenate([starts[splits], cut + 1])), np.sort(np.concatenate([ends[splits], cut])))


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _extend(words: np.ndarray, i: int, lag: int) -> tuple[int, int]:
    """The largest [start, end) around i in which words[j] == words[j + lag], by steps that double."""
    n = len(words) - lag
    end, step = i, 64
    while end < n:
        stop = min(n, end + step)
        unequal = np.flatnonzero(words[end:stop] != words[end + lag:stop + lag])
        if len(unequal):
            end += int(unequal[0])
            break
        end, step = stop, 2 * step
    start, step = i, 64
    while start > 0:
        stop = max(0, start - step)
        unequal = np.flatnonzero(words[stop:start] != words[stop + lag:start + lag])
        if len(unequal):
            start = stop + int(unequal[-1]) + 1
            break
        start, step = stop, 2 * step
    return start, end


def scan_lags(words: np.ndarray, least: int) -> list[Run]:
    """All runs of a segment: for every lag, where words equal those a lag ahead for long enough.

    At lag q such a stretch has max(q, least - q) words or more, so of probes q // 2 apart one is followed by at
    least q // 2 of them: long lags compare hashes of eight words at the probes alone and extend what agrees word by
    word. n words thus take about n log n steps, not n * n. A stretch found at a multiple of its period is skipped.
    """
    n, found, known = len(words), [], {}

    def keep(start: int, end: int, lag: int) -> None:
        found.append((start, end + lag - start, lag))
        for multiple in range(2 * lag, (end + lag - start) // 2 + 1, lag):
            known.setdefault(multiple, []).append((start, end + lag))

    hashes = None
    for lag in range(1, n // 2 + 1):
        larger = known.pop(lag, ())  # found at a divisor: all of this lag's stretches inside them are theirs
        if lag < SHORT_LAGS or n < 8 * SHORT_LAGS:
            starts, ends = _stretches(words[:-lag] == words[lag:])
            long = ends - starts >= max(lag, least - lag)
            for start, end in zip(starts[long].tolist(), ends[long].tolist()):
                if (start, end + lag) not in larger:
                    keep(start, end, lag)
            continue
        if hashes is None:
            mixed = np.random.default_rng(12).integers(0, 1 << 63, size=int(words.max()) + 1, dtype=np.uint64)[words]
            hashes = mixed
            for span in (1, 2, 4):
                hashes = hashes[:-span] * np.uint64(pow(0x9E3779B97F4A7C15, span, 1 << 64)) + hashes[span:]
        probes = np.arange(0, len(hashes) - lag, lag // 2)
        agree = probes[hashes[probes] == hashes[probes + lag]]
        for start, end in larger:
            agree = agree[(agree < start) | (agree >= end - lag)]
        past = 0
        for probe in agree.tolist():
            if probe < past:
                continue
            start, end = _extend(words, probe, lag)
            past = max(past, end)
            if end - start >= max(lag, least - lag) and (start, end + lag) not in larger:
                keep(start, end, lag)
    return found


def find_runs(texts: list[np.ndarray], least: int = 12) -> list[list[Run]]:
    """The runs of each text, given as numbered words, ascending by start, then period.

    A run is a stretch of ``least`` words or more that has a smallest period q, holds it twice at least, and that
    neither neighbouring word extends. Texts are split together and scanned segment by segment.
    """
    runs: list[list[Run]] = [[] for _ in texts]
    if not texts:
        return runs
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    if not ends[-1]:
        return runs
    # Numbers are made different from text to text, so that one sort finds the neighbours within each.
    top = np.array([int(t.max()) + 1 if len(t) else 0 for t in texts])
    words = np.concatenate(texts) + np.repeat(np.cumsum(top) - top, sizes)
    for start, end in surviving_segments(words, least, ends):
        text = int(np.searchsorted(ends, start, side="right"))
        shift = start - int(ends[text] - sizes[text])
        inside = np.unique(words[start:end], return_inverse=True)[1]
        runs[text] += [(s + shift, length, q) for s, length, q in scan_lags(inside, least)]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in runs]


def _numbered(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def _annotated(text: str, own: list[str], least: int):
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(lot, 256) for lot in range(0, batch.num_rows, 256)):
                # bytes.split() parts at the six ASCII blanks and at nothing else.
                words = [(t.as_py() or "").encode("utf-8", "surrogatepass").split() for t in part.column(text)]
                found = find_runs([_numbered(w) for w in words], least)
                kept = []
                for body, runs in zip(words, found):
                    stays = np.ones(len(body), bool)
                    for start, length, period in runs:
                        stays[start + period:start + length] = False
                    kept.append(" ".join(body[i].decode("utf-8", "surrogatepass") for i in np.flatnonzero(stays)))
                listed = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
                yield pa.record_batch(
                    [*(part.column(n) for n in own), pa.array([len(w) for w in words], pa.int64()),
                     pa.array(listed, run), pa.array(kept, pa.string())], names=[*own, "n_words", "runs", "collapsed"])
    return f


RESULT = ("n_words", "runs", "collapsed")


def periodic_runs(docs: DataFrame, *, text: str = "text", least: int = 12) -> DataFrame:
    """``docs`` with n_words, ``runs`` (start, length and period of each, in words, by start, then period) and
    ``collapsed``: the words that stand in no run behind its first period, joined by one blank.

    Words are what ASCII blanks part; two are equal if their bytes are. Texts are split by recursive frequency
    splitting (``surviving_segments``), and only what survives is scanned for lags (``scan_lags``). Work is row-local,
    without a shuffle; a task holds a lot of 256 texts.

    Null and empty texts have no words, no runs and collapse to ''. Texts of any length are read whole. Repeated
    rows are judged each by itself; null ids do not matter; an empty table gives an empty one. Columns named like the
    result's are replaced, others stay.
    """
    ship_package(docs.sparkSession)
    own = [c for c in docs.columns if c not in RESULT]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)
    return docs.select(*own).mapInArrow(
        _annotated(text, own, least),
        f"{fields}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
