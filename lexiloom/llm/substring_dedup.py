"""Substring deduplication by content-defined chunks."""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import ship_package

# Bytes of text whose passages are looked at together in a task, and that a bucket of passages stands for.
LOT_BYTES = 8 << 20
MOST_BUCKETS = 1 << 16


@dataclasses.dataclass(frozen=True)
class Chunking:
    """Sizes in bytes. A chunk ends where the rolling hash over ``window`` bytes is the largest of those up to
    ``reach`` bytes before and after, so every such cut depends on window + 2 * reach bytes around it and on no
    cut before it: chunks have 2 * reach + 1 bytes on average, more than ``reach`` each. In a gap of over
    ``largest`` bytes, such as one word over and over, the largest hash of those that may come next is the cut,
    the same in every period. A repeat is a passage: as many neighbouring chunks as make
    ``least_repeat`` bytes, which stand elsewhere side by side too. That leaves short common phrases alone, and
    texts whose chunks are found in many places, but never together.
    Of a passage found in another place, the first window + reach bytes, the last reach bytes, and what lies
    between them and the next cut inside (about reach at either end) may not be in the repeat."""

    window: int = 8
    reach: int = 12
    largest: int = 96
    least_repeat: int = 100


def gear_hash(data: np.ndarray, window: int) -> np.ndarray:
    """The gear rolling hash after every byte: the sum of (gear of byte) << age over the last ``window`` bytes.

    Sums over twice as many bytes come from two sums over half of them, so a text takes log2(window) steps.
    """
    gear = np.random.default_rng(4).integers(0, 1 << 63, size=256, dtype=np.uint64)
    h, span = gear[data], 1
    while span < window:
        older = np.zeros_like(h)
        older[span:] = h[:-span]
        h = h + (older << np.uint64(span))
        span *= 2
    return h


def _natural(hashes: np.ndarray, c: Chunking) -> list[int]:
    """Ends of chunks that the text chooses: the first largest hash within ``reach`` bytes on both sides.
    Bytes too near to an end of the text for that, and hashes of less than a window, choose nothing."""
    h = hashes[c.window - 1:]
    n = len(h) - 2 * c.reach
    if n <= 0:
        return []
    # best[i] is the largest of h[i:i + reach]: maxima over twice as many values come from two over half of them.
    best, span = h, 1
    while span < c.reach:
        step = min(span, c.reach - span)
        best, span = np.maximum(best[:len(best) - step], best[step:]), span + step
    mid = h[c.reach:c.reach + n]
    peak = (mid > best[:n]) & (mid >= best[c.reach + 1:c.reach + 1 + n])
    return (np.flatnonzero(peak) + c.reach + c.window).tolist()


def _cuts(data: bytes, c: Chunking) -> tuple[list[int], list[bool]]:
    """Ends of the chunks of a text, and which of them the text chooses."""
    out, chosen, start = [], [], 0
    h = gear_hash(np.frombuffer(data, np.uint8), c.window)
    natural = _natural(h, c)
    for i, end in enumerate([*natural, len(data)]):
        while end - start > c.largest:
            start += c.reach + 1 + int(h[start + c.reach:start + c.largest].argmax())
            out.append(start)
            chosen.append(False)
        if end > start:
            out.append(end)
            chosen.append(i < len(natural))
            start = end
    return out, chosen


def cut_points(data: bytes, c: Chunking) -> list[int]:
    """Ends of the chunks of a text; an empty text has none."""
    return _cuts(data, c)[0]


def passages(ends: list[int], least: int) -> list[int]:
    """For every chunk the number behind the last one of its passage, the fewest chunks from it on that
    make ``least`` bytes; chunks too near to the end of the text begin none and are left out."""
    out, last = [], 0
    for first in range(len(ends)):
        begin = ends[first - 1] if first else 0
        while last < len(ends) and ends[last] - begin < least:
            last += 1
        if last == len(ends):
            break
        out.append(last + 1)
    return out


def _keyed(data: bytes, c: Chunking) -> tuple[list[bytes], list[bool]]:
    """Digest of every passage of a text, and whether the text chooses all cuts in it."""
    ends, chosen = _cuts(data, c)
    found = passages(ends, c.least_repeat)
    forced = np.concatenate([[0], np.cumsum(~np.array(chosen, bool))])
    begins = [0, *ends]
    return ([hashlib.blake2b(data[begins[first]:ends[last - 1]], digest_size=16).digest() for first, last in enumerate(found)],
            [bool(forced[last] == forced[first]) for first, last in enumerate(found)])


def _groups(d1, d2, null, doc, h, x) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order by passage and place, group of each, position of its group's first, which groups are repeats)."""
    number = x >> 2
    order = np.lexsort((number, h, doc, ~null, d2, d1))
    a, b = order[1:], order[:-1]
    new = np.append(True, (d1[a] != d1[b]) | (d2[a] != d2[b]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    group = np.cumsum(new) - 1
    i, j = order[first], order[last]
    elsewhere = (null[i] != null[j]) | (doc[i] != doc[j]) | (h[i] != h[j])
    flags = np.bitwise_or.reduceat(x[order] & 3, first)
    return order, group, first[group], elsewhere | (flags & 1 > 0) | ((number[i] != number[j]) & (flags & 2 > 0))


def _places(c: Chunking, buckets: int):
    """Rows (bucket, d1, d2, doc, h, x) of parallel lists: the places of a lot's passages, by the bucket of the passage.

    x is the first chunk's number times 4, plus 2 if the text chose all cuts, plus 1 if the lot holds the passage twice.
    Of such a passage only the lot's first place is asked for elsewhere; the others are known to be later ones. They go
    out without digests, by the bucket of their text, so a passage that is found everywhere makes one entry a lot.
    """
    def packed(bucket, d1, d2, null, doc, h, x):
        by = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.append(True, np.diff(bucket[by]) != 0)) if len(by) else np.zeros(0, int)
        offsets = pa.array(np.append(at, len(by)), pa.int32())
        lists = lambda v, mask=None: pa.ListArray.from_arrays(offsets, pa.array(v[by], mask=None if mask is None else mask[by]))
        none = pa.nulls(len(at), pa.list_(pa.int64()))
        return pa.record_batch(
            [pa.array(bucket[by][at], pa.int32()), none if d1 is None else lists(d1), none if d2 is None else lists(d2),
             lists(doc, null), lists(h), lists(x)], names=["bucket", "d1", "d2", "doc", "h", "x"])

    def of(docs: pa.Array, hashes: list, counts: list, digests: list, chosen: list) -> Iterator[pa.RecordBatch]:
        keys = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        at = np.repeat(np.arange(len(counts)), counts)
        if not len(at):
            return
        d1, d2 = keys[:, 0], keys[:, 1]
        null = docs.is_null().to_numpy(zero_copy_only=False)[at]
        doc, h = docs.fill_null(0).to_numpy(zero_copy_only=False)[at], np.array(hashes, np.int64)[at]
        x = np.concatenate([np.arange(n) for n in counts]).astype(np.int32) * 4 + np.array(chosen, np.int32) * 2
        order, group, first, twice = _groups(d1, d2, null, doc, h, x)
        lead = order[first]
        own = (null[order] == null[lead]) & (doc[order] == doc[lead]) & (h[order] == h[lead]) & (x[order] >> 2 == x[lead] >> 2)
        # Rows of one id with equal texts share their places: one entry is enough.
        again = own & (np.arange(len(order)) != first)
        x[lead[twice[group]]] |= 1
        ask = np.sort(order[~twice[group] | own & ~again])
        known = np.sort(order[twice[group] & ~own])
        to = lambda v: (v.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        yield packed(to(d1[ask]), d1[ask], d2[ask], null[ask], doc[ask], h[ask], x[ask])
        if len(known):
            yield packed(to(h[known]), None, None, null[known], doc[known], h[known], x[known])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, lot = 0, 0, ([], [], [], [])
            for n, text in enumerate(batch.column(1)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                found, chosen = _keyed(data, c)
                for part, more in zip(lot, ([_text_hash(data)], [len(found)], found, chosen)):
                    part += more
                size += len(data)
                if size >= LOT_BYTES or n == batch.num_rows - 1:
                    yield from of(batch.column(0).slice(start, n + 1 - start), *lot)
                    start, size, lot = n + 1, 0, ([], [], [], [])
    return f


def _repeated(places: pa.Table) -> pa.Table:
    """(doc, h, x) of the places of a bucket's repeated passages; x is the number times 2, plus 1 if there is an earlier place."""
    flat = lambda t, n: t.column(n).combine_chunks().flatten()
    sure = places.filter(places.column("d1").is_null())
    asked = places.filter(places.column("d1").is_valid())
    out = [pa.table([flat(sure, "doc"), flat(sure, "h"), pa.array((flat(sure, "x").to_numpy() >> 2) * 2 + 1, pa.int32())], names=["_doc", "_h", "_x"])]
    if asked.num_rows:
        docs = flat(asked, "doc")
        null, doc = docs.is_null().to_numpy(zero_copy_only=False), docs.fill_null(0).to_numpy()
        d1, d2, h, x = (flat(asked, n).to_numpy() for n in ("d1", "d2", "h", "x"))
        order, group, first, many = _groups(d1, d2, null, doc, h, x)
        kept = many[group]
        i, lead = order[kept], order[first][kept]
        later = (null[i] != null[lead]) | (doc[i] != doc[lead]) | (h[i] != h[lead]) | (x[i] >> 2 != x[lead] >> 2)
        out.append(pa.table([docs.take(pa.array(i)), pa.array(h[i]), pa.array((x[i] >> 2) * 2 + later, pa.int32())], names=["_doc", "_h", "_x"]))
    return pa.concat_tables(out)


def _text_hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _rewrite(text: str, c: Chunking):
    def spans_of(data: bytes, numbers: dict[int, bool]) -> tuple[int, list, list]:
        """(chunks, repeated spans, spans to drop) in bytes; numbers: first chunk of a repeated passage -> to drop."""
        ends = cut_points(data, c)
        found = passages(ends, c.least_repeat) if numbers else []
        repeats: list[tuple[int, int]] = []
        drops: list[tuple[int, int]] = []
        for first in sorted(numbers):
            begin, end = ends[first - 1] if first else 0, ends[found[first] - 1]
            for spans in (repeats, drops)[:1 + numbers[first]]:
                if spans and begin <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], end)
                else:
                    spans.append((begin, end))
        return len(ends), repeats, drops

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            kept, cols = [], [[], [], [], []]
            for body, found in zip(batch.column(text), batch.column("_found")):
                data = (body.as_py() or "").encode("utf-8", "surrogatepass")
                numbers = {x >> 1: bool(x & 1) for x in (found.as_py() or ())}
                n, repeats, drops = spans_of(data, numbers)
                left, at = [], 0
                for start, end in drops:
                    # Chunks may end inside a character: what is dropped begins and ends at whole ones.
                    while start < end and data[start] & 0xC0 == 0x80:
                        start += 1
                    while end < len(data) and data[end] & 0xC0 == 0x80:
                        end -= 1
                    if end > start:
                        left.append(data[at:start])
                        at = end
                left.append(data[at:])
                out = b"".join(left)
                kept.append(out.decode("utf-8", "surrogatepass"))
                for col, v in zip(cols, (n, sum(e - s for s, e in repeats), len(data) - len(out),
                                         [{"first": s, "bytes": e - s} for s, e in repeats])):
                    col.append(v)
            span = pa.list_(pa.struct([("first", pa.int32()), ("bytes", pa.int32())]))
            own = [n for n in names if n != "_found"]
            yield pa.record_batch(
                [*(pa.array(kept, pa.string()) if n == text else batch.column(n) for n in own),
                 *(pa.array(v, pa.int64()) for v in cols[:3]), pa.array(cols[3], span)],
                names=[*own, "n_chunks", "n_repeated", "n_dropped", "repeats"])
    return f


def dedup_substrings(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                     chunking: Chunking | None = None) -> DataFrame:
    """``docs`` without passages that an earlier place holds; adds n_chunks, n_repeated, n_dropped (bytes) and
    the repeated spans (first byte, bytes).

    Texts are cut where a gear rolling hash of the last bytes says so, so an insertion moves only the cuts beside
    it. From every chunk on, the passage of ``least_repeat`` bytes or a little more is keyed by a 128-bit digest: a
    repeat stands somewhere else as a whole, not chunk by chunk in different places. Places travel once, as arrays
    by the bucket of the digest: a lot of texts first settles the passages it holds twice, so a passage found
    everywhere makes one entry a lot; a bucket then finds the first place (id, then number) and the later ones.
    Passages that stand in one document only count if they stand there twice and no gap's cut ends a chunk
    of them: one letter over and over is no repeat of itself. Repeats are listed wherever they stand; a chunk
    goes if it lies in a passage that has an earlier place, so every dropped byte stands earlier amid the
    same ``least_repeat`` bytes. Null texts read as '' and come back as ''. Rows of one id with equal texts share
    one place (both keep their text); a null id comes first. Result columns of the same name are replaced.
    """
    c = chunking or Chunking()
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(max(64, total // LOT_BYTES + 1), MOST_BUCKETS))
    placed = slim.mapInArrow(
        _places(c, buckets), "bucket int, d1 array<long>, d2 array<long>, doc array<long>, h array<long>, x array<int>")
    found = placed.groupBy("bucket").applyInArrow(_repeated, "_doc long, _h long, _x int")
    per_doc = found.groupBy("_doc", "_h").agg(F.collect_set("_x").alias("_found"))
    own = [x for x in docs.columns if x not in ("n_chunks", "n_repeated", "n_dropped", "repeats", "_found")]

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [_text_hash((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(text)]
            yield pa.record_batch([*batch.columns, pa.array(h, pa.int64())], names=[*batch.schema.names, "_hash"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)
    hashed = docs.select(*own).mapInArrow(hashes, f"{fields}, _hash long")
    joined = hashed.join(
        per_doc, hashed[key].cast("long").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_h")), "left")
    return joined.select(*own, "_found").mapInArrow(
        _rewrite(text, c), f"{fields}, n_chunks long, n_repeated long, n_dropped long, "
        "repeats array<struct<first:int,bytes:int>>")
