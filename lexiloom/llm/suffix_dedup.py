"""Repeated substrings by suffix arrays, built in two stages, over the places that may hold one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexiloom.llm.common import written
from lexiloom.session import ship_package

GRAM = 24  # bytes of the grams whose smallest hash routes a window
CHUNK = 1 << 20  # windows hashed at once
BLOCK_WINDOWS = 1 << 17  # windows of one routing key in one suffix array; more are split and settled by digest
BATCH_BYTES = 1 << 21  # bytes sorted at once, more only for a single block
BUCKET_BITS = 10  # of a routing key's number: keys are counted by bucket
LOT = 1 << 21  # keys a task holds before it passes on their counts
FILTER_BITS, MOST_BITS = 10, 1 << 30  # of the filter of repeated keys, each and in all; a fuller one only lets more pieces pass
MOST_DOCUMENTS = 4_000_000  # marks that are sent to all tasks; more documents are joined by a shuffle


# --- routing: which windows of the text may be equal to others ---

def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A mixed polynomial hash of ``size`` bytes from every byte on; longer sums come from two shorter ones."""
    gear = np.random.default_rng(13).integers(0, 1 << 63, size=256, dtype=np.uint64)
    base, wide = 0x9E3779B97F4A7C15, gear[data]
    out, done, span = None, 0, 1
    while size:
        if size & 1:
            if out is None:
                out, done = wide, span
            else:
                n = len(data) - done - span + 1
                out, done = out[:n] * np.uint64(pow(base, span, 1 << 64)) + wide[done:done + n], done + span
        size >>= 1
        if size:
            n = len(wide) - span
            wide, span = wide[:n] * np.uint64(pow(base, span, 1 << 64)) + wide[span:], 2 * span
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _routes(data: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``least`` bytes: where its smallest gram hash stands (the first of equals), and all hashes."""
    hashes = _gram_hashes(data, gram)
    best = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    wanted, span = least - gram + 1, 1
    while span < wanted:
        step = min(span, wanted - span)
        best, span = np.minimum(best[:len(best) - step], best[step:]), span + step
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64), hashes


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, without a copy; nulls have no bytes."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    return np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8), offsets


def _pieces_of(data: np.ndarray, offsets: np.ndarray, least: int, gram: int):
    """(row, start, windows, places, key) of runs of windows that share a routing key, over all texts of a batch."""
    low, high = int(offsets[0]), int(offsets[-1])
    for begin in range(low, high - least + 1, CHUNK):
        part = data[begin:min(begin + CHUNK + least - 1, high)]
        where, hashes = _routes(part, least, gram)
        row = np.searchsorted(offsets, np.arange(begin, begin + len(where)), side="right") - 1
        inside = offsets[row + 1] - (begin + np.arange(len(where))) >= least
        key = hashes[where].view(np.int64)
        fresh = np.ones(len(where), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        place = np.ones(len(where), bool)
        place[1:] = (where[1:] != where[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(fresh)
        # The last windows of a text that would run into the next one are none; they end their run.
        windows, places = np.add.reduceat(inside, first, dtype=np.int64), np.add.reduceat(place & inside, first, dtype=np.int64)
        keep = windows > 0
        first = first[keep]
        yield row[first], begin + first - offsets[row[first]], windows[keep], np.maximum(places[keep], 1), key[first]


class _Marked:
    """The documents of a list of (mark, hash): a document's mark, or without hashes any document of a listed mark."""

    def __init__(self, marks: np.ndarray, hashes: np.ndarray | None = None):
        order = np.argsort(marks, kind="stable")
        self.marks, self.hashes = marks[order], None if hashes is None else hashes[order]
        self.run = int(np.unique(marks, return_counts=True)[1].max(initial=0))  # marks of equal value, more than one hardly ever

    def holds(self, mark: pa.Array, h: pa.Array) -> np.ndarray:
        mark, h = mark.to_numpy(), h.to_numpy()
        out, at = np.zeros(len(mark), bool), np.searchsorted(self.marks, mark)
        for step in range(self.run):
            here = at + step < len(self.marks)
            place = np.minimum(at + step, len(self.marks) - 1)
            out |= here & (self.marks[place] == mark) & (True if self.hashes is None else self.hashes[place] == h)
        return out


def _number(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number) of routing keys: 42 mixed bits, as the smallest of many hashes is small."""
    key = key.view(np.uint64)
    mixed = (key ^ (key >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    mixed ^= mixed >> np.uint64(28)
    return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), ((mixed >> np.uint64(22)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _probes(number: np.ndarray, bucket_bits: int) -> list[np.ndarray]:
    """The bits, within the part of its bucket, that a number sets in the filter."""
    return [((number.astype(np.uint64) * np.uint64(c) >> np.uint64(24)) % np.uint64(bucket_bits)).astype(np.int64)
            for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _counted(least: int, gram: int, copies):
    """Texts (h, mark, body) to the numbers of their keys by bucket, each once a lot, with its windows and whether it
    stands in two places: a byte, and what exceeds it in ``more``."""
    names = ["bucket", "numbers", "sizes", "more", "windows"]

    def lot(held: list[tuple]) -> pa.RecordBatch:
        bucket, number, windows, places = (np.concatenate(x) for x in zip(*held))
        whole = (bucket.astype(np.uint64) << np.uint64(32)) | number
        order = np.argsort(whole, kind="stable")
        first = np.flatnonzero(np.append(True, whole[order][1:] != whole[order][:-1]))
        bucket, number = bucket[order][first], number[order][first]
        windows, places = np.add.reduceat(windows[order], first), np.add.reduceat(places[order], first)
        sizes = (np.minimum(windows, 127) | np.where(places > 1, 128, 0)).astype(np.uint8)
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        rows = []
        for i, j in zip(cuts.tolist(), cuts[1:].tolist()):
            big = i + np.flatnonzero(windows[i:j] > 127)
            rows.append((bucket[i], number[i:j].tobytes(), sizes[i:j].tobytes(), number[big].tobytes(), (windows[big] - 127).tobytes()))
        kinds = [pa.int32(), *[pa.binary()] * 4]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if copies is not None:
                batch = batch.filter(pa.array(~copies.value.holds(batch.column(1), batch.column(0))))
            if not batch.num_rows:
                continue
            for _, _, windows, places, key in _pieces_of(*_buffers(batch.column(2)), least, gram):
                held.append((*_number(key), windows, places))
                size += len(key)
                if size > LOT:
                    yield lot(held)
                    held, size = [], 0
        if size:
            yield lot(held)
    return f


def _repeated(block_windows: int):
    """The lots of a bucket to the numbers that stand in two places or more, and those of them with more windows than a
    block takes, with their blocks."""
    def f(lots: pa.Table) -> pa.Table:
        numbers, sizes, more, extra = (
            np.frombuffer(b"".join(lots.column(c).to_pylist()), k)
            for c, k in (("numbers", np.uint32), ("sizes", np.uint8), ("more", np.uint32), ("windows", np.int64)))
        distinct, at = np.unique(numbers, return_inverse=True)
        places = np.bincount(at, 1 + (sizes >> 7), len(distinct))
        windows = np.bincount(at, sizes & 127, len(distinct)) + np.bincount(np.searchsorted(distinct, more), extra, len(distinct))
        often, hot = places > 1, (places > 1) & (windows > block_windows)
        salts = np.ceil(windows[hot] / block_windows).astype(np.int32)
        return pa.table(
            [lots.column("bucket").slice(0, 1).cast(pa.int32()), pa.array([int(often.sum())], pa.int64()), pa.array([distinct[often].tobytes()], pa.binary()),
             pa.array([distinct[hot].tobytes()], pa.binary()), pa.array([salts.tobytes()], pa.binary())],
            names=["bucket", "n", "often", "hot", "salts"])
    return f


def _bits(bucket_bits: int):
    """The numbers of a bucket to its part of the filter."""
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for often in batch.column(1).to_pylist():
                bits = np.zeros(bucket_bits, bool)
                for probe in _probes(np.frombuffer(often, np.uint32), bucket_bits):
                    bits[probe] = True
                parts.append(np.packbits(bits).tobytes())
            yield pa.record_batch([batch.column(0), pa.array(parts, pa.binary())], names=["bucket", "bits"])
    return f


class _Often:
    """Which keys may stand in two places (all that do, and few others), and in how many blocks the frequent ones are split."""

    def __init__(self, table: DataFrame):
        total = table.agg(F.sum("n")).first()[0] or 0
        self.bucket_bits = 8 * (1 + min(FILTER_BITS * total, MOST_BITS) // (8 << BUCKET_BITS))
        self.bits = np.zeros((1 << BUCKET_BITS) * self.bucket_bits // 8, np.uint8)
        width = self.bucket_bits // 8
        for batch in table.where("n > 0").select("bucket", "often").mapInArrow(_bits(self.bucket_bits), "bucket int, bits binary").toArrow().to_batches():
            for bucket, bits in zip(batch.column(0).to_pylist(), batch.column(1)):
                self.bits[bucket * width:(bucket + 1) * width] = np.frombuffer(bits.as_buffer(), np.uint8)
        split = table.where("octet_length(hot) > 0").select("bucket", "hot", "salts").orderBy("bucket").toArrow().to_pylist()
        self.hot = np.concatenate([np.zeros(0, np.uint64), *(
            (np.uint64(r["bucket"]) << np.uint64(32)) | np.frombuffer(r["hot"], np.uint32).astype(np.uint64) for r in split)])
        self.salts = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r["salts"], np.int32) for r in split)])

    def of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the keys that may stand in two places, blocks of each of these)."""
        bucket, number = _number(key)
        maybe = np.ones(len(key), bool)
        for probe in _probes(number, self.bucket_bits):
            bit = bucket * self.bucket_bits + probe
            maybe &= (self.bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0
        at = np.flatnonzero(maybe)
        salts = np.ones(len(at), np.int32)
        if len(self.hot):
            whole = (bucket[at].astype(np.uint64) << np.uint64(32)) | number[at]
            place = np.minimum(np.searchsorted(self.hot, whole), len(self.hot) - 1)
            salts = np.where(self.hot[place] == whole, self.salts[place], 1).astype(np.int32)
        return at, salts


def _cut_out(least: int, gram: int, often, copies):
    """Texts (h, mark, body, id) to one row a piece whose key may stand in two places, with its bytes."""
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if copies is not None:
                batch = batch.filter(pa.array(~copies.value.holds(batch.column(1), batch.column(0))))
            if not batch.num_rows:
                continue
            data, offsets = _buffers(batch.column(2))
            for row, start, windows, _, key in _pieces_of(data, offsets, least, gram):
                chosen, salts = often.value.of(key)
                if not len(chosen):
                    continue
                row, start, size, key = row[chosen], start[chosen], windows[chosen] + least - 1, key[chosen]
                ends = np.cumsum(size)
                source = np.repeat(offsets[row] + start - (ends - size), size) + np.arange(ends[-1])
                body = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(size),
                    [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[source]))])
                h = batch.column(0).take(pa.array(row))
                salt = ((h.to_numpy() ^ (start * np.int64(0x9E3779B97F4A7C1))).view(np.uint64) >> np.uint64(20)) % salts.astype(np.uint64)
                yield pa.record_batch(
                    [pa.array(key), pa.array(salt.astype(np.int32)), pa.array(salts), batch.column(3).take(pa.array(row)), h,
                     pa.array(start, pa.int64()), body.cast(pa.binary())],
                    names=["key", "salt", "salts", "id", "h", "start", "body"])
    return f


# --- sorting: two stages ---

def _words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every byte on, as a number that compares as they do."""
    w = data.astype(np.uint64)
    for span in (1, 2, 4):
        w = (w[:-span] << np.uint64(8 * span)) | w[span:]
    return w


def _tail(depth: int, k: int) -> np.uint64:
    """Mask of the bytes of the word at ``k`` that lie within ``depth``."""
    return np.uint64((0xFFFFFFFFFFFFFFFF << 8 * max(0, 8 - (depth - k))) & 0xFFFFFFFFFFFFFFFF)


def _sort_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their first ``depth`` bytes, word by word; only ties that are out of order move again."""
    first = words[places]
    order = np.argsort(first, kind="stable")
    places, first = places[order], first[order]
    tie = np.zeros(len(places), bool)
    tie[1:] = first[1:] == first[:-1]
    for k in range(8, depth, 8):
        member = tie.copy()
        member[:-1] |= tie[1:]
        at = np.flatnonzero(member)
        if not len(at):
            break
        word, tied = words[places[at] + k] & _tail(depth, k), tie[at]
        group = np.cumsum(~tied)
        falls = tied[1:] & (word[1:] < word[:-1])
        if falls.any():
            mixed = np.zeros(group[-1] + 1, bool)
            mixed[group[1:][falls]] = True
            chosen = np.flatnonzero(mixed[group])
            move = chosen[np.lexsort((word[chosen], group[chosen]))]
            places[at[chosen]], word[chosen] = places[at[move]], word[move]
        tied[1:] &= word[1:] == word[:-1]
        tie[at] = tied
    return places


def sorted_suffixes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, judged: np.ndarray, depth: int,
                    words: np.ndarray | None = None) -> np.ndarray:
    """The first ``judged`` places of every piece ``data[begin:end]``, in the order of the ``depth`` bytes from there.

    Each judged place has ``depth`` bytes within its piece; pieces lie side by side. Sorted directly are suffixes
    smaller than their successors, and those that begin with ``depth`` equal bytes. The rest is larger than its
    successor: buckets of first bytes are scanned upwards, and each sorted suffix puts its predecessor into the
    predecessor's bucket, before the directly sorted ones. ``data`` has ``depth`` + 8 spare bytes behind the last piece.
    """
    n = int(ends[-1])
    words = _words(data) if words is None else words
    last = np.zeros(n, bool)
    last[ends - 1] = True
    change = last | (data[:n] != data[1:n + 1])
    turn = np.flatnonzero(change)  # where the byte changes, or the piece ends
    of = np.cumsum(change) - change
    rises = ~last[turn] & (data[turn + 1] > data[turn])
    direct = rises[of] | (turn[of] - np.arange(n) >= depth - 1)
    # The last judged places need their successors up to one that is sorted directly.
    directly = np.append(np.flatnonzero(direct), n)
    reach = np.minimum(directly[np.searchsorted(directly, begins + judged - 1)], ends - 1)
    edge = np.bincount(begins, minlength=n + 1) - np.bincount(reach + 1, minlength=n + 1)
    wanted = np.cumsum(edge)[:n] > 0
    induced = wanted & ~direct
    induced_before = np.zeros(n, bool)  # whether the place before is of the same piece and is induced from this one
    induced_before[1:] = induced[:-1] & ~last[:-1]

    stage_one = _sort_directly(np.flatnonzero(wanted & direct), words, depth)
    bounds = np.searchsorted(data[stage_one], np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]

    def deal(places: np.ndarray) -> None:
        byte = data[places]
        order = np.argsort(byte, kind="stable")
        places, byte = places[order], byte[order]
        cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
        for lot in np.split(places, cuts):
            if len(lot):
                queues[data[lot[0]]].append(lot)

    deal(np.flatnonzero(induced & last))  # what is followed by the end of a piece comes first
    out = []
    for byte in range(256):
        bucket = []
        wave = np.concatenate(queues[byte]) if queues[byte] else np.zeros(0, np.int64)
        while len(wave):  # a byte before its equal: one more of it, so behind all with fewer
            bucket.append(wave)
            before = wave[induced_before[wave]] - 1
            wave = before[data[before] == byte]
        bucket.append(stage_one[bounds[byte]:bounds[byte + 1]])
        bucket = np.concatenate(bucket)
        out.append(bucket)
        before = bucket[induced_before[bucket]] - 1
        deal(before[data[before] > byte])
    order = np.concatenate(out)
    mine = np.zeros(n + 1, np.int64)
    mine[begins] += 1
    np.subtract.at(mine, begins + judged, 1)
    return order[np.cumsum(mine)[order] > 0]


def common_prefixes(order: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Bytes, up to ``depth``, that each suffix shares with the one before it in the order; the first shares none."""
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for k in range(0, depth, 8):
        differ = (words[order[alive] + k] ^ words[order[alive - 1] + k]) & _tail(depth, k)
        same = differ == 0
        stop = alive[~same]
        for byte in range(1, 8):
            out[stop] += differ[~same] < np.uint64(1 << (64 - 8 * byte))
        alive = alive[same]
        out[alive] += min(8, depth - k)
    return out


# --- judging: which windows start earlier elsewhere ---

def _judge(rows: list[tuple], least: int):
    """Spans of windows that start earlier in the same block, and, of split blocks, the windows that start first."""
    body = b"".join(r[6] for r in rows)
    data = np.frombuffer(body + bytes(least + 8), np.uint8)
    size = np.array([len(r[6]) for r in rows], np.int64)
    ends = np.cumsum(size)
    begins, judged = ends - size, size - (least - 1)
    words = _words(data)
    order = sorted_suffixes(data, begins, ends, judged, least, words)
    fresh = common_prefixes(order, words, least) < least
    owner = np.repeat(np.arange(len(rows)), size)
    _, who = np.unique(np.array([r[4] for r in rows], np.int64), return_inverse=True)
    ids = pc.rank(pa.array([r[3] for r in rows]), null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    _, document = np.unique(np.stack([ids, who]), axis=1, return_inverse=True)
    start = np.array([r[5] for r in rows], np.int64)
    place = (document.reshape(-1)[owner] << np.int64(40)) + np.arange(len(owner)) - begins[owner] + start[owner]
    mine = place[order]
    groups = np.flatnonzero(fresh)
    least_of = np.repeat(np.minimum.reduceat(mine, groups), np.diff(np.append(groups, len(order)))) if len(order) else mine
    later = np.zeros(len(owner) + 1, bool)
    later[order[mine > least_of]] = True
    edge = np.diff(later.astype(np.int8), prepend=0)
    opens, closes = np.flatnonzero(edge[:-1] == 1), np.flatnonzero(edge == -1)
    # Windows of neighbouring pieces never touch: a piece's last bytes begin no window.
    spans = [(owner[o], start[owner[o]] + o - begins[owner[o]], start[owner[o]] + c - 1 - begins[owner[o]] + least)
             for o, c in zip(opens.tolist(), closes.tolist())]
    split = np.array([r[2] > 1 for r in rows])
    first = order[(mine == least_of) & split[owner[order]]] if split.any() else np.zeros(0, np.int64)
    return spans, [(body[i:i + least], owner[i], int(start[owner[i]] + i - begins[owner[i]])) for i in first.tolist()]


def _suffix_sorted(least: int, id_type: pa.DataType):
    names = ["id", "h", "start", "end", "window"]
    kinds = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        spans, firsts = _judge(rows, least)
        out = [(rows[o][3], rows[o][4], s, e, None) for o, s, e in spans]
        out += [(rows[o][3], rows[o][4], s, s + least, w) for w, o, s in firsts]
        return pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], names=names)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, block = [], 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size > BATCH_BYTES and row[:2] != block:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size, block = size + len(row[6]), row[:2]
        if held:
            yield settle(held)
    return f


def _without(text: str, key_names: list[str]):
    """Cuts the spans out of the text's bytes."""
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first", pa.int64()), ("bytes", pa.int64())]))
        for batch in batches:
            kept, sizes, removed, listed = [], [], [], []
            for body, found, whole in zip(batch.column(text), batch.column("_spans"), batch.column("_copy")):
                data = (body.as_py() or "").encode("utf-8", "surrogatepass")
                pairs = sorted((x["start"], x["end"]) for x in found.as_py() or ())
                if whole.as_py():
                    pairs = [(0, len(data))]
                merged: list[list[int]] = []
                for s, e in pairs:
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                left, at = [], 0
                for s, e in merged:
                    left.append(data[at:s])
                    at = e
                left.append(data[at:])
                out = b"".join(left)
                kept.append(out)
                sizes.append(len(data))
                removed.append(len(data) - len(out))
                listed.append([{"first": s, "bytes": e - s} for s, e in merged])
            yield pa.record_batch(
                [*(batch.column(n) for n in key_names), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(removed, pa.int64()), pa.array(listed, span)],
                names=[*key_names, "kept", "n_bytes", "n_removed", "removed"])
    return f


def _as_they_are(text: str, key_names: list[str], copies, spanned):
    """Rows (own columns, _h, _mark): copies lose all their bytes, documents without a span none; others are left out."""
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark, h = batch.column("_mark"), batch.column("_h")
            copy = np.zeros(len(mark), bool) if copies is None else copies.value.holds(mark, h)
            chosen = pa.array(copy | ~spanned.value.holds(mark, h))
            batch, copy = batch.filter(chosen), copy[chosen.to_numpy(zero_copy_only=False)]
            if not batch.num_rows:
                continue
            body = pc.fill_null(batch.column(text).cast(pa.binary()), b"")
            size = pc.binary_length(body).cast(pa.int64()).to_numpy()
            gone = pa.StructArray.from_arrays([pa.array(np.zeros(copy.sum(), np.int64)), pa.array(size[copy])], names=["first", "bytes"])
            spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(copy)).astype(np.int32)), gone)
            kept = pc.if_else(pa.array(copy), pa.scalar(b"", pa.binary()), body)
            yield pa.record_batch(
                [*(batch.column(n) for n in key_names), kept, pa.array(size), pa.array(np.where(copy, size, 0)), spans],
                names=[*key_names, *RESULT])
    return f


def _with_spans(copies, spanned):
    """The rows (own columns, _h, _mark) that ``_as_they_are`` leaves out."""
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark, h = batch.column("_mark"), batch.column("_h")
            chosen = spanned.value.holds(mark, h)
            if copies is not None:
                chosen &= ~copies.value.holds(mark, h)
            yield batch.filter(pa.array(chosen))
    return f


RESULT = ("kept", "n_bytes", "n_removed", "removed")


def dedup_suffixes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 100,
                   gram: int = GRAM, block_windows: int = BLOCK_WINDOWS, most_documents: int = MOST_DOCUMENTS) -> DataFrame:
    """``docs`` with the bytes that are left once every byte goes that a string of ``least`` bytes covers which also
    starts earlier (smaller id, or earlier in the same text): ``kept`` (binary; a cut may fall inside a character),
    n_bytes, n_removed and the removed runs (first byte, bytes).

    All equal windows of ``least`` bytes have the same smallest gram hash, which routes them to one task. The hashes are
    counted as numbers of five bytes; a filter of those that stand in two places is sent to all tasks, and only the runs of
    windows that pass it travel, with their bytes. Texts travel only to meet the spans found in them; whole copies and
    documents without a span are told by their marks, up to ``most_documents`` of each. A task sorts the suffixes of what
    it gets in two stages (``sorted_suffixes``), computes adjacent common prefixes, and finds in every stretch of
    equal windows the one that starts first. Hashes only route: bytes decide. The windows of a frequent hash are
    split into blocks; the first windows of the blocks are then compared by a 256-bit digest, with partial sums.
    Exact copies of a text need no routing: all but the first id's are removed whole, if ``least`` bytes long.

    Null texts read as empty. A null id comes first; rows of one id are documents ordered by their text's hash, and
    rows equal in id and text are one document, each with the same result. ``least`` is greater than ``gram``.
    Texts may be of any length and any characters; an empty table gives an empty one. Other columns stay;
    columns named like the result's are replaced.
    """
    ship_package(docs.sparkSession)
    own = [c for c in docs.columns if c not in RESULT]
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(*own).withColumn("_h", F.xxhash64(body))
    id_type = docs.schema[key].dataType
    kind = id_type.simpleString()
    mark = lambda i, h: F.xxhash64(F.lit(7), i, h).alias("mark")
    slim = keyed.select(F.col("_h").alias("h"), mark(key, "_h"), body.cast("binary").alias("body"), F.col(key).alias("id")).where(
        F.length("body") >= least)
    digest = docs.select(F.col(key).alias("id"), F.xxhash64(body).alias("h"), F.sha2(body, 256).alias("d"), F.octet_length(body).alias("n"))
    firsts = digest.where(F.col("n") >= least).groupBy("d").agg(
        F.min(F.struct("id")).alias("first"), F.count_distinct(F.struct("id")).alias("ids")).where("ids > 1").drop("ids")
    copies = written(digest.where(F.col("n") >= least).join(firsts, "d").where(~F.col("id").eqNullSafe(F.col("first.id"))).select(
        "id", "h").distinct(), "copies")
    context = docs.sparkSession.sparkContext

    def sent(rows: DataFrame, *columns):
        """The marks of documents in every task, or none of too many."""
        if rows.count() > most_documents:
            return None
        return context.broadcast(_Marked(*(c.to_numpy() for c in rows.select(*columns).toArrow().columns)))

    whole = sent(copies, mark("id", "h"), "h")
    often = written(slim.select("h", "mark", "body").mapInArrow(
        _counted(least, gram, whole), "bucket int, numbers binary, sizes binary, more binary, windows binary").groupBy("bucket").applyInArrow(
        _repeated(block_windows), "bucket int, n long, often binary, hot binary, salts binary"), "repeated-keys")
    pieces = slim.mapInArrow(
        _cut_out(least, gram, context.broadcast(_Often(often)), whole),
        f"key long, salt int, salts int, id {kind}, h long, start long, body binary")
    blocks = pieces.repartition("key", "salt").sortWithinPartitions("key", "salt")
    judged = blocks.mapInArrow(_suffix_sorted(least, to_arrow_type(id_type)), f"id {kind}, h long, start long, end long, window binary")
    judged = written(judged, "judged")

    place = F.struct("id", "h", "start")
    rivals = judged.where("window is not null").select("id", "h", "start", F.sha2("window", 256).alias("d"))
    best = rivals.groupBy("d").agg(F.min(place).alias("best"))
    late = rivals.join(best, "d").where(~place.eqNullSafe(F.col("best"))).select(
        "id", "h", "start", (F.col("start") + least).alias("end"))
    spans = judged.where("window is null").select("id", "h", "start", "end").unionByName(late).groupBy("id", "h").agg(
        F.collect_set(F.struct("start", "end")).alias("_spans")).withColumn("_copy", F.lit(False))
    # Copies that are too many to be sent were judged like others; they go as a whole, whatever was found in them.
    if whole is None:
        other = copies.select(F.col("id").alias("_id"), F.col("h").alias("_hh"))
        spans = spans.join(other, spans["id"].eqNullSafe(F.col("_id")) & (spans["h"] == F.col("_hh")), "left_anti").unionByName(
            copies.select("id", "h", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("_spans"), F.lit(True).alias("_copy")))
    spans = written(spans, "spans")
    spanned = sent(spans, mark("id", "h"))
    verdicts = spans.select(F.col("id").alias("_id"), F.col("h").alias("_hh"), "_spans", "_copy")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)
    result = f"{fields}, kept binary, n_bytes long, n_removed long, removed array<struct<first:bigint,bytes:bigint>>"
    marked = keyed.withColumn("_mark", mark(key, "_h"))
    asked = keyed if spanned is None else marked.mapInArrow(_with_spans(whole, spanned), f"{fields}, _h long, _mark long")
    if spanned is None and whole is not None:  # all texts are joined, and so are the copies
        verdicts = verdicts.unionByName(copies.select(
            F.col("id").alias("_id"), F.col("h").alias("_hh"), F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("_spans"), F.lit(True).alias("_copy")))
    joined = asked.join(verdicts, asked[key].eqNullSafe(F.col("_id")) & (asked["_h"] == F.col("_hh")), "left")
    cut = joined.select(*own, "_spans", "_copy").mapInArrow(_without(text, own), result)
    return cut if spanned is None else cut.unionByName(marked.mapInArrow(_as_they_are(text, own, whole, spanned), result))
